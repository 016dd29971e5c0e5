import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from verlog.llm import chat_tree, common, embedding_dedup, jaccard_join, queries
from verlog.llm.common import connected_components

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("few", [0, 500_000])
def test_components_of_random_graphs(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW", few)
    draw = random.Random(1)
    pairs = [(draw.randint(0, 400), draw.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, i) for i in range(5001, 5300)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    lonely = {a for a, b in pairs if a == b} - {x for a, b in pairs if a != b for x in (a, b)}
    assert {x: got.get(x, x) for x in root} == {x: find(x) for x in root} and not lonely & got.keys()
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_staged_files_go(spark):
    df = common.stage(spark.range(3), "some")
    at = common._made[-1]
    assert df.count() == 3
    common.clean_up(spark)
    with pytest.raises(Exception):
        spark.read.parquet(at).count()


def test_the_shared_folder_is_never_one_of_the_machine_on_a_cluster(spark):
    class Session:
        def __init__(self, master, at=None):
            self.sparkContext = type("Context", (), {"master": master})
            self.conf = type("Conf", (), {"get": staticmethod(lambda key, default: at)})

    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert common.shared_dir(Session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    for master in ("spark://h:7077", "yarn", "k8s://h", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            common.shared_dir(Session(master))


def test_owners_delete_what_they_staged(spark):
    import os

    with common.owned() as made:
        df = common.stage(spark.range(3), "kept")
        with common.owned() as inner:
            common.stage(spark.range(2), "inner")
    assert len(made) == 1 and len(inner) == 1 and not set(made) & set(inner)
    common.delete(spark, inner)
    assert df.count() == 3 and not os.path.exists(inner[0].removeprefix("file://"))
    common.drop_staged(df)
    assert not os.path.exists(made[0].removeprefix("file://"))
    assert common.fresh(spark.range(1).toDF("AT"), "at") == "at_"


# --- chats


def chats(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, node int, ids string")


CONTROL = "<|im_end|><|im_start|>assistant ok <\\|a <\\\\|b \\n"


@pytest.fixture(scope="module")
def built(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", CONTROL), (2, 0, "user", "hi"), (2, 1, "assistant", "other"), (3, 0, "user", "hi"), (4, 1, "assistant", None), (4, 0, None, CONTROL),
            (5, 0, "sys\ntem\\", "é😀 中"), (5, 0, "sys\ntem\\", "é😀 中"), (6, 0, "user", "hi"), (6, 1, "assistant", CONTROL), (None, 3, "user", ""), (7, 0, "user", "long " * 30_000), (8, 2, "user", "b"), (8, 1, "user", "b")]
    rows += [(9, i, "user", f"turn {i}") for i in range(200)]
    df = chats(spark, rows)
    return (rows, *chat_tree.build(df))


def test_reading_back(spark, built):
    rows, nodes, members = built
    got = {r.conv_id: r for r in chat_tree.read_back(nodes, members).collect()}
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t, role or "", text or ""))
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()


def test_shared_turns_are_laid_out_once_depth_first(built):
    rows, nodes, members = built
    at = {bytes(r.node): r for r in nodes.collect()}
    paths = {}
    for r in members.orderBy("idx").collect():
        paths.setdefault(r.conv_id, []).append(bytes(r.node))
    assert paths[1] == paths[6] and paths[1][0] == paths[2][0] == paths[3][0] and paths[1][1] != paths[2][1]
    order = sorted(at.values(), key=lambda r: r.start)
    assert sum(r.n_ids for r in order) == order[-1].start + order[-1].n_ids and order[0].start == 0
    parent = {}
    for p in paths.values():
        before = 0
        for k, n in enumerate(p):
            parent[n] = p[k - 1] if k else None
            r = at[n]
            assert r.position == before and r.depth == k + 1
            spans = list(zip(r.attends[::2], r.attends[1::2]))
            want = sorted(x for m in p[:k] for x in range(at[m].start, at[m].start + at[m].n_ids))
            assert [x for a, b in sorted(spans) for x in range(a, b)] == want
            before += r.n_ids
    # depth first: what lies between a node and its subtree's end is its subtree
    stack = []
    for r in order:
        n = bytes(r.node)
        while stack and stack[-1] != parent[n]:
            stack.pop()
        assert (parent[n] is None) == (not stack)
        stack.append(n)


def test_escapes():
    draw = random.Random(0)
    for _ in range(3000):
        t = "".join(draw.choices(["<", "|", "\\", "n", "\n", "im_end", "|>", "<|im_start|>"], k=draw.randint(0, 9)))
        assert chat_tree.unescape(chat_tree.escape(t)) == t and "<|" not in chat_tree.escape(t)
        assert chat_tree.unescape_role(chat_tree.escape_role(t)) == t and "\n" not in chat_tree.escape_role(t)


def test_chats_equal_sql_and_nothing(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    rel = con.sql(queries.OP3_SQL)
    df = queries.op3_chat_tree(spark, SF)
    assert sorted(tuple(r[c] for c in rel.columns) for r in df.collect()) == sorted(map(tuple, rel.fetchall()))
    assert chat_tree.read_back(*chat_tree.build(chats(spark, []))).count() == 0


# --- embeddings


def brute_links(rows, least=0.98):
    links = {i: 0 for i, _, _ in rows}
    root = {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, v, l) in enumerate(rows):
        for j, w, m in rows[k + 1 :]:
            if l is None or l != m or not v or not w or len(v) != len(w) or any(x is None or not np.isfinite(x) for x in v + w):
                continue
            a, b = np.array(v, float), np.array(w, float)
            if a.any() and b.any() and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i in links}


def vectors(seed=0, families=6, size=12, dim=9):
    draw = np.random.default_rng(seed)
    rows = []
    for f in range(families):
        base = draw.normal(size=dim)
        for _ in range(size):
            rows.append((len(rows), [float(np.float32(x)) for x in base + draw.normal(size=dim) * 0.12], int(draw.integers(0, 2))))
    rows += [(1000 + k, list(rows[k][1]), rows[k][2]) for k in range(5)] + [(1100 + k, [2.5 * x for x in rows[k][1]], rows[k][2]) for k in range(5)]
    rows += [(2000, None, 1), (2001, [0.0] * dim, 1), (2002, [float("nan")] * dim, 1), (2003, [None] + [1.0] * (dim - 1), 1), (2004, [1.0], 1), (2005, [2.0], 1), (2006, rows[0][1], None), (2007, [], 1), (2008, [float("inf")] * dim, 0), (2009, [1e30, 1e-30], 0), (2010, [1e30, 0.0], 0)]
    return rows


@pytest.mark.parametrize("hot", [20_000, 3])
def test_links_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(embedding_dedup, "HOT", hot)
    rows = vectors()
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, id int").repartition(3)
    want = brute_links([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows])
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == want and any(n for n, _ in want.values())


def test_cells_are_visited_nearest_first():
    draw = np.random.default_rng(4)
    for _ in range(50):
        a, b = np.sort(draw.random(draw.integers(1, 9))), np.sort(draw.random(draw.integers(1, 9)))
        limit = draw.random() * 2
        got = list(embedding_dedup.multi_sequence(a, b, limit))
        want = sorted((a[i] + b[j], i, j) for i in range(len(a)) for j in range(len(b)) if a[i] + b[j] <= limit)
        assert [t for *_, t in got] == [t for t, *_ in want] and {(i, j) for i, j, _ in got} == {(i, j) for _, i, j in want}


def test_a_target_recall_is_reached(spark):
    rows = vectors(seed=3, families=12, size=30)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.measured_recall(df, recall=1.0, every=1) == 1.0
    assert embedding_dedup.measured_recall(df, recall=0.9, every=1) >= 0.9
    some = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, recall=0.5).collect()}
    every = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    assert all(some[i] <= every[i] for i in every) and 0.5 * sum(every.values()) <= sum(some.values())


def test_no_vectors_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.vec_id or 0, r.n_links) for r in embedding_dedup.near_duplicates(df).collect()) == [(0, 0), (1, 1), (1, 1)]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_lower_bounds_hold():
    draw = np.random.default_rng(1)
    x, c = draw.normal(size=(300, 5)), draw.normal(size=(7, 5))
    home, low = embedding_dedup.bounds(x, c)
    for i in range(0, 300, 7):
        for j in range(300):
            assert ((x[i] - x[j]) ** 2).sum() >= low[i, home[j]] - 1e-9


# --- Jaccard join


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefghij", k=3))
    passage = [word() for _ in range(60)]
    texts = [[word() for _ in range(draw.choice([1, 3, 5, 9, 40, 150]))] for _ in range(60)]
    for _ in range(4):  # families of near copies of several strengths
        base = [word() for _ in range(draw.choice([20, 80, 200]))]
        for _ in range(40):
            t = list(base)
            for _ in range(draw.randint(0, 1 + len(base) // 18)):
                at = draw.randrange(len(t))
                t[at : at + draw.randint(0, 2)] = [word() for _ in range(draw.randint(0, 2))]
            texts.append(t)
    texts += [draw.choice(texts) + passage for _ in range(30)]
    texts = [" ".join(t) for t in texts]
    texts += [t.upper() for t in texts[:5]] + [t.replace(" ", "\x0b\n") for t in texts[5:9]] + [None, "", " \t", "é x", "É x"]
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,cell", [(1, 256), (2, 256), (3, 4)])
def test_classes_equal_brute_force(spark, monkeypatch, seed, cell):
    monkeypatch.setattr(jaccard_join, "CELL", cell)
    monkeypatch.setattr(jaccard_join, "BUCKET", 2000)
    monkeypatch.setattr(jaccard_join, "CHUNK", 4000)
    monkeypatch.setattr(jaccard_join, "PARTNERS", 3)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, cls string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(df).collect()}
    want = brute_classes(rows)
    assert got == want and sum(c != i for i, (_, c) in want.items()) > 20
    if seed == 1:
        kept = jaccard_join.keep_first(df)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i)


def edited(draw, text, edits):
    words = text.split()
    for at in draw.sample(range(len(words)), edits):
        words[at] = f"e{draw.randint(0, 10**6)}"
    return " ".join(words)


def test_regions_replicas_and_levels_are_all_needed(spark, monkeypatch):
    """Each way by which links are found: without it, some are lost."""
    draw = random.Random(5)
    base = " ".join(f"b{draw.randint(0, 10**6)}" for _ in range(120))
    near = [edited(draw, base, 2) for _ in range(15)]  # within a region
    texts = [edited(draw, base, 1) for _ in range(60)] + near + [edited(draw, t, 1) for t in near]  # the last: beyond it, linked to members
    texts += [f"only {i} " + " ".join(f"o{i}x{k}" for k in range(50 + i)) for i in range(20)]
    texts += [t + " and a few words" for t in texts[95:105]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
    want = brute_classes(rows)

    def found():
        return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(df).collect()}

    seen = []
    deal = jaccard_join._pair_up
    monkeypatch.setattr(jaccard_join, "_pair_up", lambda dealt, cell: seen.append(cell) or deal(dealt, cell))
    assert found() == want and seen == [jaccard_join.CELL]
    placed = []
    monkeypatch.setattr(jaccard_join, "_pair_up", lambda dealt, cell: placed.append(deal(dealt, cell)) or placed[-1])
    found()
    kinds = {r.kind: r["count"] for r in placed[0].groupBy("kind").count().collect()}
    assert all(kinds.get(k) for k in (jaccard_join.PAIR, jaccard_join.HOME, jaccard_join.REPLICA))
    for gone in (jaccard_join.PAIR, jaccard_join.HOME):
        monkeypatch.setattr(jaccard_join, "_pair_up", lambda dealt, cell, gone=gone: deal(dealt, cell).where(f"kind <> {gone}"))
        assert found() != want
    monkeypatch.setattr(jaccard_join, "_pair_up", deal)
    meet = jaccard_join._meet
    monkeypatch.setattr(jaccard_join, "_meet", lambda r, m, w: meet(r, m, w).limit(0))
    assert found() != want
    monkeypatch.setattr(jaccard_join, "_meet", meet)
    monkeypatch.setattr(jaccard_join, "CELL", 2)  # every family meets in cells that are too large
    monkeypatch.setattr(jaccard_join, "PIVOTS", 0)
    seen.clear()
    monkeypatch.setattr(jaccard_join, "_pair_up", lambda dealt, cell: seen.append(cell) or deal(dealt, cell))
    assert found() == want and len(seen) > 2


def test_filter_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", 1), (2, "a b c d e f", 2), (2, "a b c d e f", 3), (3, "x", 4), (3, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, at int")
    df = df.withColumns({c: F.col("at") for c in ("same", "nth", "__at", "__id", "__nth", "cls", "n", "root", "kind", "a", "b")})
    kept = jaccard_join.keep_first(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_large_cells_are_paired_whole(spark, monkeypatch):
    """Without pivots and frequent shingles the cells alone find every link."""
    monkeypatch.setattr(jaccard_join, "PIVOTS", 0)
    monkeypatch.setattr(jaccard_join, "FREQUENT_FROM", 10**9)
    rows = [(i, f"a{i} " + " ".join(f"w{k}" for k in range(60))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in jaccard_join.jaccard_classes(df).collect()} == {0}


def test_copies_repeats_and_nothing(spark):
    df = spark.createDataFrame([(5, "one two three"), (5, "one two three"), (3, "one two three"), (None, "one two three"), (9, None), (9, None)], "doc_id long, text string").withColumn("n", F.lit(1))
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_join.jaccard_classes(df).collect())
    assert got == [(0, 3), (3, 3), (5, 3), (5, 3), (9, 9), (9, 9)]
    assert sorted(r.doc_id or 0 for r in jaccard_join.keep_first(df).collect()) == [0, 3, 9]
    assert jaccard_join.jaccard_classes(df.limit(0)).count() == 0


def test_null_and_shared_ids_keep_their_links_apart(spark):
    base = [f"w{k}" for k in range(100)]
    near = base[:88] + [f"x{k}" for k in range(12)]
    nearer = [f"y{k}" for k in range(12)] + near[12:]  # linked to near, not to base
    links = [spark.createDataFrame(rows, "doc_id long, text string") for rows in (
        [(1, " ".join(base)), (None, " ".join(near)), (2, " ".join(nearer)), (None, "alone here")],
        [(3, " ".join(base)), (7, " ".join(near)), (7, "other words " + " ".join(f"v{k}" for k in range(60))), (9, "other words " + " ".join(f"v{k}" for k in range(59)))],
    )]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles) for r in jaccard_join.jaccard_classes(links[0]).collect())
    assert brute_classes([(1, " ".join(base)), (2, " ".join(nearer))])[2][1] == 2
    assert got == [(0, 0, 1), (0, 1, 96), (1, 1, 96), (2, 1, 96)]
    assert sorted(r.doc_id or 0 for r in jaccard_join.keep_first(links[0]).collect()) == [0, 0, 1]
    got = sorted((r.doc_id, r.component_id, r.n_shingles) for r in jaccard_join.jaccard_classes(links[1]).collect())
    assert got == [(3, 3, 96), (7, 3, 96), (7, 7, 58), (9, 7, 57)]
    kept = jaccard_join.keep_first(links[1]).collect()
    assert sorted((r.doc_id, r.text[:5]) for r in kept) == [(3, "w0 w1"), (7, "other")]
    # repeats, and two near copies under one id, leave one row; unlinked texts under one id both stay
    rows = [(5, " ".join(base)), (5, " ".join(base)), (5, " ".join(near)), (5, "something else"), (6, "something else")]
    kept = jaccard_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text[:5]) for r in kept) == [(5, "somet"), (5, "w0 w1")]
