"""Folds against plain loops written from their definitions."""

import json
import random

import pytest

from treeline.functions import text as T
from treeline.operators import pages, toc, tree
from treeline.plans import seam


def loop_groups(tokens, limit, overlap):
    groups, first, held = [], 0, 0
    for i, n in enumerate(tokens):
        if i > first and held + n > limit:
            groups.append((first, i - 1))
            first = max(i - overlap, 0)
            held = sum(tokens[first:i])
        held += n
    return groups + [(first, len(tokens) - 1)]


def test_page_groups(spark):
    r = random.Random(1)
    docs = {d: [r.randint(0, 900) for _ in range(r.randint(1, 40))] for d in range(25)}
    rows = spark.createDataFrame([(d, i + 1, n) for d, t in docs.items() for i, n in enumerate(t)], "doc_id int, page_no int, n_tokens int")
    for overlap in (0, 1, 2):
        got = {}
        for x in pages.page_groups(rows, 1500, overlap).collect():
            got.setdefault(x.doc_id, []).append((x.first, x.last))
        for d, t in docs.items():
            total = sum(t)
            parts = -(-total // 1500)
            want = [(0, len(t) - 1)] if total <= 1500 else loop_groups(t, -(-(total + 1500 * parts) // (2 * parts)), overlap)
            assert sorted(got[d]) == want, (d, overlap)


def test_greedy_groups_and_texts(spark):
    rows = spark.createDataFrame([(1, i, f"t{i}", n) for i, n in enumerate([5, 5, 5, 20, 1, 1])], "doc_id int, seq int, t string, n int")
    groups = pages.greedy_groups(rows, "seq", "n", 10)
    assert [(x.first, x.last) for x in groups.orderBy("group").collect()] == loop_groups([5, 5, 5, 20, 1, 1], 10, 0)
    texts = pages.group_texts(groups, rows, "seq", "t", "+").orderBy("group").collect()
    assert [x.text for x in texts][:2] == ["t0+t1", "t2"]


def test_line_chunks(spark):
    lines = [(1, i, "x" * n) for i, n in enumerate([3, 4, 8, 1, 1, 30, 2])]
    got = [(x.first, x.last) for x in pages.line_chunks(spark.createDataFrame(lines, "doc_id int, line_no int, line string"), 3).orderBy("group").collect()]
    want, current, first = [], [], 0
    for i, (_, _, line) in enumerate(lines):
        if current and (len("\n".join([*current, line])) + 3) // 4 > 3:
            want.append((first, i - 1))
            current, first = [], i
        current.append(line)
    assert got == [*want, (first, len(lines) - 1)]


def test_split_points_fit_and_rejoin():
    r = random.Random(2)
    for _ in range(50):
        text = "".join(r.choice(["word ", "end. ", "\n", "\n\n", "abc"]) for _ in range(r.randint(0, 4000)))
        cuts = pages.split_points(text, 600)
        assert "".join(text[a:b] for a, b in zip(cuts, cuts[1:])) == text and cuts == sorted(cuts)
    assert pages.split_points("", 5) == [0, 0] and pages.split_points("abc", None) == [0, 3]


@pytest.mark.parametrize("seed", range(3))
def test_collapse(spark, seed):
    r = random.Random(seed)
    rows = [(d, i, r.choice([None, "1", "2", "2.1"]), r.choice(["A", "a (Continued)", "B", None, "A - part 3"]), r.choice([None, 1, 2])) for d in range(8) for i in range(12)]
    got = toc.collapse(spark.createDataFrame(rows, "doc_id int, seq int, structure string, title string, physical_index int")).collect()
    strip = lambda t: (t or "").replace(" (Continued)", "").replace(" - part 3", "")
    want = []
    for d in range(8):
        kept = []
        for _, i, s, t, p in (x for x in rows if x[0] == d):
            s, t, p = s or "", strip(t).lower(), "" if p is None else str(p)
            alike = lambda y: (s and y[1] == s) or (t and y[2] == t)
            if (kept and alike(kept[-1])) or (p and any(alike(y) and y[3] == p for y in kept)):
                continue
            kept.append((i, s, t, p))
        want += [(d, k[0]) for k in kept]
    assert sorted((x.doc_id, x.seq) for x in got) == want


def test_codes_to_tree(spark):
    rows = [(1, i, c, f"t{i}", i, i + 1) for i, c in enumerate(["1", "1.1", "1.3.2.1", "1.3.4", "9.1", "1", "1.1.1", "2", None])]
    items = spark.createDataFrame(rows, "doc_id int, seq int, structure string, title string, start_index int, end_index int")
    got = tree.codes_to_tree(items).orderBy("node_seq").collect()
    assert [(x.structure, x.parent_seq, x.depth, x.synthesized) for x in got] == [
        ("1", None, 0, False), ("1.1", 0, 1, False), ("1.1.1", 1, 2, False), ("1.3", 0, 1, True), ("1.3.2", 3, 2, True), ("1.3.2.1", 4, 3, False), ("1.3.4", 3, 2, False),
        ("9.1", None, 0, False), ("1", None, 0, False), ("2", None, 0, False), (None, None, 0, False),
    ]
    assert (got[3].start_index, got[3].end_index) == (2, 4)


def test_tree_of_random_levels(spark):
    r = random.Random(4)
    rows = [(d, i, r.randint(1, 6), f"t{i}", "x") for d in range(6) for i in range(25)]
    t = tree.subtree_ends(tree.numbered(tree.depths(tree.parents_from_levels(spark.createDataFrame(rows, "doc_id int, seq int, level int, title string, text string")))))
    got = {(x.doc_id, x.seq): x for x in t.collect()}
    for d in range(6):
        stack = []
        for _, i, level, *_ in (x for x in rows if x[0] == d):
            while stack and stack[-1][1] >= level:
                stack.pop()
            x = got[d, i]
            assert x.parent_seq == (stack[-1][0] if stack else None) and x.depth == len(stack) and x.node_seq == i
            stack.append((i, level))


def test_node_ids_past_four_digits(spark):
    """Ids are padded, never cut: zfill(4) of the number."""
    rows = spark.range(10020).selectExpr("1 AS doc_id", "array(cast(id AS int)) AS path", "cast(id AS int) AS seq")
    got = {x.node_seq: x.node_id for x in tree.numbered(rows).collect()}
    assert got == {i: str(i).zfill(4) for i in range(10020)}


def test_structure_budget_ladder(spark):
    r = random.Random(8)
    rows = [(1, i, 1 if i % 9 == 0 else r.randint(2, 4), f"title {i}", "x") for i in range(60)]
    levels = spark.createDataFrame(rows, "doc_id int, seq int, level int, title string, text string")
    nodes = tree.subtree_ends(tree.numbered(tree.depths(tree.parents_from_levels(levels))))
    from pyspark.sql import functions as F

    nodes = nodes.withColumn("summary", F.concat(F.lit("summary of "), "title")).cache()
    view = nodes.orderBy("node_seq").collect()
    text = lambda **kv: len(json.dumps(kv, separators=(",", ":")))

    def fits(depth, chars, budget):
        shown = [x for x in view if depth is None or x.depth < depth]
        # Without summaries the field is empty.
        size = sum(text(title=x.title, node_id=x.node_id, summary=x.summary[:chars] if chars else "") + 14 for x in shown)
        return size <= budget

    tops = [x for x in view if x.depth == 0]
    met = set()
    for budget in (10**6, 4200, 3000, 1500, 700, 500, 250, 90):
        want = next(((d, c, None) for d, c in ((None, 160), (3, 160), (2, 160), (1, 160), (1, 0)) if fits(d, c, budget)), None)
        if want is None:
            n = len(tops)
            while n > 1:
                n //= 2
                if sum(text(title=x.title, node_id=x.node_id) + 2 for x in tops[:n]) <= budget:
                    break
            want = (1, 0, n)
        shown, fit = tree.document_structure(nodes, 1, budget=budget)
        assert (fit["max_depth"], fit["summary_chars"], fit["top_n"]) == want, budget
        met.add(want)
        got = [x.node_seq for x in shown.collect()]
        assert got == [x.node_seq for x in (tops[: want[2]] if want[2] else [x for x in view if want[0] is None or x.depth < want[0]])]
    assert len(met) >= 5


def test_codes_to_tree_of_random_codes(spark):
    """Depths and parents of random dotted codes: every prefix of a code is a node above it."""
    r = random.Random(9)
    for turn in range(3):
        codes = sorted({".".join(str(r.randint(1, 3)) for _ in range(r.randint(1, 4))) for _ in range(25)}, key=lambda c: [int(x) for x in c.split(".")])
        rows = [(1, i, c, f"t{c}", i + 1, i + 1) for i, c in enumerate(codes)]
        items = spark.createDataFrame(rows, "doc_id int, seq int, structure string, title string, start_index int, end_index int")
        got = {x.structure: x for x in tree.codes_to_tree(items).collect()}
        by_seq = {x.node_seq: x for x in got.values()}
        for c in codes:
            x, up = got[c], c.rpartition(".")[0]
            assert not x.synthesized
            if up and any(k.split(".")[0] == c.split(".")[0] and "." not in k for k in codes):
                assert by_seq[x.parent_seq].structure == up and x.depth == c.count(".")
            elif not up:
                assert x.parent_seq is None and x.depth == 0


def test_codes_to_tree_of_many_documents(spark):
    """Documents that straddle Arrow batches, null keys and codes; no call of Python per document."""
    r = random.Random(11)
    code = lambda: r.choice([None, "", ".".join(str(r.randint(1, 3)) for _ in range(r.randint(1, 5)))])
    page = lambda: r.choice([None, r.randint(1, 9)])
    rows = [(d, i, code(), r.choice([None, f"t{i}"]), page(), page()) for d in [None, *range(60)] for i in range(r.randint(1, 12))]
    want = []
    for d in [None, *range(60)]:
        nodes, latest = [], {}  # [code, title, start, end, parent, synthesized]
        for _, _, c, t, a, b in (x for x in rows if x[0] == d):
            parts = (c or "").split(".")
            above = [".".join(parts[:n]) for n in range(1, len(parts))]
            have = max((n for n, p in enumerate(above) if p in latest), default=None)
            up = None if have is None else latest[above[have]]
            for p in [] if have is None else above[have + 1 :]:
                latest[p], up = len(nodes), (nodes.append([p, f"Section {p}", a, b, up, True]), len(nodes) - 1)[1]
            if c is not None:
                latest[c] = len(nodes)
            nodes.append([c, t, a, b, up, False])
        kids = {i: [j for j, x in enumerate(nodes) if x[4] == i] for i in [None, *range(len(nodes))]}
        for i in reversed(range(len(nodes))):
            for field, pick in ((2, min), (3, max)) if nodes[i][5] else ():
                nodes[i][field] = pick((nodes[j][field] for j in kids[i] if nodes[j][field] is not None), default=nodes[i][field])
        number = {}

        def walk(i, depth):
            number[i] = len(number)
            c, t, a, b, up, made = nodes[i]
            want.append((d, number[i], number.get(up), depth, c, t, a, b, made))
            for j in kids[i]:
                walk(j, depth + 1)

        for i in kids[None]:
            walk(i, 0)
    r.shuffle(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = tree.codes_to_tree(spark.createDataFrame(rows, "doc_id long, seq int, structure string, title string, start_index int, end_index int"))
        assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
        order = lambda x: (x[0] is None, x[0] or 0, x[1])
        assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_page_trees_fall_back_to_headings(spark):
    from treeline.plans import build

    pages_ = [(1, n, f"{n}. Heading number {'abcdef'[n]}\nsome words of the page {n}.") for n in range(1, 6)]
    got = build.page_trees(spark.createDataFrame(pages_, "doc_id int, page_no int, page_text string")).orderBy("node_seq").collect()
    assert [(x.title, x.start_index) for x in got] == [(f"Heading number {'abcdef'[n]}", n) for n in range(1, 6)]


@pytest.mark.parametrize("seed", range(2))
def test_first_pages(spark, seed):
    """As title_at_start says of every page in reach: titles that begin alike or are repeated, late and cut ones, nulls."""
    r = random.Random(seed)
    words = ["Chapter", "Chap", "ter", "a", "B-2", "customer 01", "customer 012", "x" * 70, "ﬁ"]
    text = lambda most: " ".join(r.choice(words) for _ in range(r.randint(0, most)))
    pages_ = [(d, n, r.choice([None, text(3), text(60), "z" * r.randint(140, 180) + text(4), "z" * r.randint(1480, 1500) + text(2)])) for d in range(3) for n in range(1, 25)]
    titles = [None, "", "--", "absent title"] + [text(3) for _ in range(30)]
    rows = [(d, i, t, r.choice([-1, 1, r.randint(1, 24)]), r.choice([toc.FAR, r.randint(1, 24)])) for d in range(4) for i, t in enumerate(titles + titles)]
    pages_ = spark.createDataFrame(pages_, "doc_id int, page_no int, page_text string").cache()
    rows = spark.createDataFrame(rows, "doc_id int, seq int, title string, prev_index int, next_index int").cache()
    tried = toc.candidate_pages(rows, pages_).where(T.title_at_start("title", "page_text") == "yes")
    want = {}
    for x in tried.collect():
        want[x.doc_id, x.seq] = min(x.page_no, want.get((x.doc_id, x.seq), x.page_no))
    got = toc.first_pages(rows, pages_)
    assert got.schema["page_no"].dataType == pages_.schema["page_no"].dataType
    assert {(x.doc_id, x.seq): x.page_no for x in got.collect()} == want and len(want) > 30


def test_titles_are_not_tried_on_every_page(spark, monkeypatch):
    """Neither search spells out the pages within reach of an item: that is the square of a long book's pages."""
    monkeypatch.setattr(toc, "candidate_pages", None)
    pages_ = spark.createDataFrame([(1, n, f"Title {n}\nx") for n in range(1, 9)], "doc_id int, page_no int, page_text string")
    items = spark.createDataFrame([(1, i, f"Title {i + 1}", i + 1 if i % 2 else None) for i in range(8)], "doc_id int, seq int, title string, physical_index int")
    assert {x.seq: x.physical_index for x in seam.find_indices(items, pages_).collect()} == {i: i + 1 for i in range(8)}
    moved = spark.createDataFrame([(1, i, f"Title {i + 1}", 4 if i == 4 else i + 1) for i in range(8)], "doc_id int, seq int, title string, physical_index int")
    got = toc.repair(moved, moved.where("seq = 4"), pages_).collect()
    assert {x.seq: x.physical_index for x in got} == {i: i + 1 for i in range(8)}


def test_long_contents_are_repaired_throughout(spark):
    """More than 200 entries, every tenth with the page after its own: all are verified, not a sample."""
    from treeline.plans import build

    n = 260
    contents = "Contents\n" + "\n".join(f"{k + 1} Person{k:04d} ........ {k + 1 + (k % 10 == 9)}" for k in range(n))
    pages_ = [(1, 1, "A cover"), (1, 2, contents)] + [(1, k + 3, f"Person{k:04d}\nand more") for k in range(n)]
    got = build.page_trees(spark.createDataFrame(pages_, "doc_id int, page_no int, page_text string")).collect()
    assert {x.title: x.start_index for x in got} == {"Preface": 1, **{f"Person{k:04d}": k + 3 for k in range(n)}}


def test_page_numbers_past_five_digits(spark):
    """They are read whole, with their title; numbers of up to five digits and those within titles as ever."""
    lines = {
        "1 Customer#000900123 ........ 100124": ("Customer#000900123", 100124), "1.1 Six : 123456789": ("Six", 123456789), "2 Plain 100125": ("Plain", 100125), "3 Tight.....100126": ("Tight", 100126),
        "4 Spaced ..... 1 2 3 4 5": ("Spaced", 12345), "5 Results vol. 3 12345": ("Results vol. 3", 12345), "6 Roman xii": ("Roman", None),
    }
    got = toc.parse(spark.createDataFrame([(1, "\n".join(lines))], "doc_id int, text string")).orderBy("seq").collect()
    assert [(x.title, x.page) for x in got] == list(lines.values())
    looks = lambda *texts: [x[0] for x in spark.createDataFrame([(t,) for t in texts], "t string").select(toc.looks_like_toc("t")).collect()]
    assert looks("a ..... 100124\nb ... 100125\nc", "revenue 1200300\ncost 900100\nc", "a 12\nb 13\nc") == [True, False, True]


def test_books_numbered_past_99999(spark):
    """A volume whose pages are numbered on from those before it: contents found, aligned, verified and repaired."""
    from treeline.plans import build

    n = 30
    contents = "Contents\n" + "\n".join(f"{k + 1} Person{k:04d} ........ {k + 99_990 + (k % 10 == 9)}" for k in range(n))
    pages_ = [(1, 1, "A cover"), (1, 2, contents)] + [(1, k + 3, f"Person{k:04d}\nand more") for k in range(n)]
    got = build.page_trees(spark.createDataFrame(pages_, "doc_id int, page_no int, page_text string")).collect()
    assert {x.title: x.start_index for x in got} == {"Preface": 1, **{f"Person{k:04d}": k + 3 for k in range(n)}}


def test_configurations_are_compared(spark):
    from treeline.plans import build

    nodes = spark.createDataFrame([(f"d{i}", "0", " ".join(f"w{(i + j) % 9}" for j in range(4)) + f" only{i}") for i in range(9)], "doc_id string, node_id string, text string")
    vectors = spark.createDataFrame([(f"d{i}", "0", [1.0 if j == i else 0.0 for j in range(9)]) for i in range(9)], "doc_id string, node_id string, embedding array<double>")
    asked = [(i, f"only{i} w{i}", [(f"d{i}", None)]) for i in range(4)]
    questions = spark.createDataFrame(asked, "id int, question string, relevant array<struct<doc_id: string, node_id: string>>")
    qvectors = spark.createDataFrame([(i, [1.0 if j == i else 0.1 for j in range(9)]) for i in range(4)], "id int, embedding array<double>")
    out = build.compared(nodes, ("doc_id", "node_id"), ["text"], questions, vectors, qvectors).collect()
    assert [x.configuration for x in out] == list(build.CONFIGURATIONS)
    alone = build.compared(nodes, ("doc_id", "node_id"), ["text"], questions)
    assert [x.configuration for x in alone.collect()] == ["bm25"]
