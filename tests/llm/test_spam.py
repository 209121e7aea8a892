import random
from collections import Counter

from leafmill.llm import spam as S


def by_counting(s, occurrences, length):
    """Characters in a substring of `length` letters that occurs often enough: the same measure by counting."""
    grams = [s[i : i + length] for i in range(len(s) - length + 1)]
    n = Counter(grams)
    inside = set()
    for i, g in enumerate(grams):
        if n[g] >= occurrences:
            inside.update(range(i, i + length))
    return len(inside)


def test_coverage_of_the_automaton_equals_counting():
    rng = random.Random(8)
    for _ in range(300):
        s = "".join(rng.choice("ab" if rng.random() < 0.5 else "abcdef") for _ in range(rng.randint(0, 90)))
        for occurrences, length in ((2, 3), (3, 4), (3, 8)):
            assert S.covered(s, occurrences, length) == by_counting(s, occurrences, length), (s, occurrences, length)


SPAM = [
    "best essay help | essay help free | Essay Help | essay help | best essay help | essay help free | essay help",
    "citationtool citati0n t00l c​itation tool CITATION TOOL citation-tool citation_tool citati0n-t00l citation tool free",
    "论文代写|免费论文免费论文|论文查重|论文代写论文查重|免费论文|论文查重论文代写|论文代写|免费论文|论文查重",
    "paper summary in Bestmere, paper summary in Skelova, paper summary in Miorburg, paper summary in Permere, paper summary in Kriolova",
    "http://a-deals.example/dl/1\nwww.b.invalid/x\nhttps://get-c.test/?q=1\nc.example/page",
    '<a href="http://x.test/1">best help</a> <a href="http://y.test/2">cheap paper</a>',
    "#essay-help #essayhelp #essay_help #topic\n#essayhelpfree #model",
    "Essay Help Case | SKU 56108 | 278.99 | annual, A4\nKioprio Stand | SKU 28671 | 289.99 | latent, A5",
    "Our free ebook beats every free ebook. Best free ebook for you. Get free ebook now, free ebook today! Looking for free ebook? We have free ebook.",
    "tag: tensor online, best citation tool\nbest citation tool » lafiox pdf\nHome > citation tool > tensor online",
]
HONEST = [
    None,
    "",
    " \n\t",
    "As the survey shows, the method is applied to all of the records, and it is not clear whether the result holds for the others. We observe that the estimate is stable in most of the cases.",
    "References\n[1] Kobriox, D.. On the Early Use of Citations. Annals of Corpus Work, 2019, pp. 3-16. http://get-suras24.example/?q=1\n[2] Preamtraind, A.. A Static Record. Workshop on Page Reading, 2024, pp. 4-17.",
    "Programme\n09:00  Repri: A Theoretical Result for Citation (Gaimfield)\n09:20  travhi and the Maximal Hypothesis (Trioxstad)\n09:40  Towards Zeathbro with Relevant Memory (Zarkmere)",
    "- If the listing is restored by the theory, its dimension is clarified as well. https://quiosta.invalid/dl/83631 To keep the transition stable, it is bounded once.\n- Readers of the volume will recognise the statistic, yet it is not new. https://b.test/1",
    "若准确率不满足复杂假定,则琛颢无法修正结构,记录也会随之变化。本文采用琛颢对网络进行分析,并扩展其显著边界与概率之间的记录。",
    "目录\n1.0 基于炀榆的连续模型研究 ....... 3\n1.1 面向瑾焓的公开目标分析 ...... 7\n1.2 澈泓与稳健覆盖率的关系 ..... 11",
]


def test_pages():
    assert [S.share(t) > 0.5 for t in SPAM] == [True] * len(SPAM)
    assert [S.share(t) > 0.5 for t in HONEST] == [False] * len(HONEST)


def test_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(SPAM + HONEST)] + [(0, SPAM[0], "y"), (None, SPAM[1], "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, share string")  # `share` clashes with the result
    got = sorted((r.doc_id for r in S.stuffed(df).collect()), key=str)
    assert got == sorted([*range(len(SPAM)), 0, None], key=str)
    assert S.shares(df.limit(0)).count() == 0
    assert S.share("best essay help " * 20_000) > 0.9


def test_stuffing_on_less_than_half_of_a_page_has_its_share():
    prose = "As the survey shows, the method is applied to all of the records, and it is not clear whether the result holds for the others. "
    stuffed = "best essay help cheap essay help " * 9
    page = prose * 3 + "\n" + stuffed
    letters = lambda t: len(t) - t.count(" ")
    assert abs(S.share(page) - letters(stuffed) / letters(page)) < 0.03 and 0.35 < S.share(page) < 0.5


def test_hosts_of_any_suffix_are_links():
    names = ["alpha-deals", "betashop", "gammabuy", "deltaoffer", "epsilonmart", "zetasale"]
    for suffixes in (["de", "io", "ru", "xyz"], ["com", "info", "net", "org"]):
        assert S.share("\n".join(f"{n}.{s}" for n in names for s in suffixes)) > 0.9
    assert S.share("e.g. this, i.e. that; z.B. dies usw. vgl. oben") < 0.5


def test_page_numbers_do_not_hide_stuffing():
    page = "\n".join(f"best cheap essay help online 20{i:02} pp. {i}" for i in range(20))
    assert S.share(page) > 0.8
    honest = "\n".join(f"[{i}] {a}, X. On {b} and {c}. Annals of Corpus Work, 20{i:02}, pp. {i}-{i + 9}." for i, (a, b, c) in enumerate(zip("Kobriox Preamt Zeathb Travhi Repri Gaimf Trioxs Zarkm".split(), "citations records theory corpora pages margins proofs sets".split(), "links tables scans models titles words trees sums".split())))
    assert S.share(honest) < 0.5


def test_prose_of_an_unlisted_language_is_kept():
    minutes = [
        "Rada gminy na sesji w dniu piątym maja przyjęła uchwałę o budżecie i nie wniosła do niej żadnych uwag.",
        "Wójt mówił o stanie dróg w gminie, po czym radni pytali go o koszty i do dyskusji nie doszło.",
        "Na wniosek komisji rada odłożyła sprawę szkoły do jesieni, bo w planie nie ma na nią środków i ludzi.",
        "Po przerwie radni wrócili do punktu o wodociągach i w głosowaniu nie przyjęli go, choć do końca trwał spór.",
        "Skarga mieszkańca na hałas w nocy trafiła do policji i nie będzie jej na kolejnej sesji, o co prosił.",
        "Przewodnicząca podała, że w czerwcu posiedzenie nie odbędzie się, i poprosiła o wnioski do lipca na piśmie.",
    ]
    assert S.share("\n".join(minutes * 3)) < 0.5


def test_a_very_long_page_needs_little_memory():
    import tracemalloc

    page = "best essay help cheap paper online " * 30_000  # a million characters
    tracemalloc.start()
    assert S.share(page) > 0.9
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * len(page)
