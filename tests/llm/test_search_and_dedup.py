"""Winnowing, top-k search, near-duplicates, line dedup, resampling and the pipeline against plain versions."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from riskline.llm import chosen_path, components, importance, line_dedup, va_file, winnow
from riskline.llm.common import staged

LOWER = {c: c + 32 for c in range(65, 91)}


def vocabulary(rng, n=400):
    return ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(n)]


def edited(rng, words, changes, fresh):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice(fresh)
    return words


def groups(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# --- winnowing ----------------------------------------------------------------

def plain_contamination(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hit, found = set(), set()
    for item_id, item in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item or "").translate(LOWER))
        n = min(10, len(w))
        windows = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i:i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item_id))
    return len(words), len(hit), sorted(found)


def test_contamination_equals_plain(spark):
    rng = random.Random(2)
    vocab = vocabulary(rng, 60)
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(10, 40)))) for i in range(25)]
    items += [(100, "Only three words"), (101, "zz"), (102, None), (103, "..."), (104, items[0][1]), (9, items[1][1].upper()),
              (105, "la " * 30), (106, "É été ÜBER x y z 1 2 3 4 5")]
    texts = [None, "", "-- !", "only THREE words, here", "Zz top", "la " * 9, "la " * 10, "la " * 500, "été É über", "É été über x y z 1 2 3 4"]
    for _ in range(150):
        words = rng.choices(vocab, k=rng.randrange(1, 60))
        for _ in range(rng.randrange(3)):
            w = rng.choice(items)[1]
            w = (w or "").split()
            a = rng.randrange(len(w) + 1)
            at = rng.randrange(len(words) + 1)
            words[at:at] = w[a:a + rng.randrange(5, 25)]
        texts.append(rng.choice([" ", ", ", "\n"]).join(words))
    rows = [Row(doc_id=i, text=t, hits=1, key="k", n_words=0) for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits int, key string, n_words int")
    bench = spark.createDataFrame([Row(item_id=i, text=t, doc_id=0) for i, t in items], "item_id long, text string, doc_id int")
    got = winnow.contamination(docs, bench).withColumn("n_hit", winnow.covered_words("spans")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_hit, r["items"]) == plain_contamination(texts[r.doc_id], items), texts[r.doc_id]
    clean = {r.doc_id for r in winnow.decontaminate(docs, bench).collect()}
    assert clean == {i for i, t in enumerate(texts) if not plain_contamination(t, items)[2]}
    assert winnow.decontaminate(docs, bench).columns == docs.columns


def test_contamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.spans, r["items"]) for r in winnow.contamination(docs, none).orderBy(F.desc("n_words")).collect()] == [(3, [], []), (0, [], [])]
    assert winnow.contamination(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert winnow.decontaminate(docs, none).count() == 2


def test_every_shared_window_leaves_a_fingerprint():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 6, 3000).astype(np.uint64)  # many ties
    kept = set(winnow.winnow(words, np.array([0, 1500, 3000])).tolist())
    for i in list(range(0, 1491)) + list(range(1500, 2991)):
        assert any(p in kept for p in range(i, i + 6))


# --- top-k --------------------------------------------------------------------

def test_top_k_equals_plain(spark):
    rng = np.random.default_rng(1)
    vectors = [[float(x) for x in rng.normal(size=16).round(2)] for _ in range(600)]
    vectors[7] = vectors[8] = vectors[300]
    odd = {20: None, 21: [1.0, None] + [0.0] * 14, 22: [float("nan")] * 16, 23: [float("inf")] + [0.0] * 15, 24: [], 100: None, 40: [0.5] * 4, 41: [0.0] * 16}
    rows = [Row(vec_id=i, embedding=odd.get(i, v), score=1, cells="c") for i, v in enumerate(vectors)] + [Row(vec_id=None, embedding=vectors[0], score=1, cells="c")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, cells string")
    got = va_file.top_k(table, F.col("vec_id") % 20 == 0, k=10).collect()
    ints = {}
    for i, v in enumerate(vectors):
        v = odd.get(i, v)
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints[i] = np.array([math.floor(1024 * x) for x in v] + [0] * (16 - len(v)))
    want = set()
    for q in ints:
        if q % 20 == 0:
            best = sorted(((-int(ints[q] @ ints[i]), i) for i in ints if i != q))[:10]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want and len(got) == len(want)


def test_top_k_of_few_and_none(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (100, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in va_file.top_k(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 100, 1024 * 1024), (0, 2, 1, 1024 * 512), (100, 1, 0, 1024 * 1024), (100, 2, 1, 1024 * 1024)]
    assert va_file.top_k(table.limit(0), F.lit(True)).count() == 0
    assert va_file.top_k(table.where("vec_id = 0"), F.lit(True)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x = rng.integers(-3000, 3000, (200, 8)).astype(float)
    g = va_file.Approximation(x.min(axis=0), x.max(axis=0))
    low, high = g.slack(x[:20])
    corner = x[:20] @ g.corners(g.cells(x)).T
    exact = x[:20] @ x.T
    assert (corner + low[:, None] <= exact).all() and (exact <= corner + high[:, None]).all()


# --- near-duplicates ----------------------------------------------------------

def plain_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def near_texts(seed):
    rng = random.Random(seed)
    vocab = vocabulary(rng)
    texts = [None, "", " \n\t", "one", "ONE", "one two", "a b c d e", "A B\nC D E"]
    for _ in range(25):
        words = rng.choices(vocab, k=rng.randrange(20, 200))
        texts += [" ".join(edited(rng, words, rng.randrange(0, 6), vocab)) for _ in range(rng.randrange(1, 9))]
    hub = rng.choices(vocab, k=190)
    texts += [" ".join(edited(rng, hub, rng.randrange(2, 7), vocab)) for _ in range(150)]  # copies that link through few
    passage = rng.choices(vocab, k=60)
    texts += [" ".join(rng.choices(vocab, k=80) + passage) for _ in range(90)]  # one passage, no links
    texts += [" ".join(rng.choices(vocab, k=9)) for _ in range(5)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("leaf,depth", [(64, 8), (6, 2)])
def test_near_duplicates_equal_plain(spark, monkeypatch, leaf, depth):
    monkeypatch.setattr(chosen_path, "LEAF", leaf)
    monkeypatch.setattr(chosen_path, "DEPTH", depth)
    texts = near_texts(leaf)
    sets = plain_sets(texts)
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups(len(texts), links)
    docs = spark.createDataFrame([Row(doc_id=i, text=t, row=1, v="v", n=0) for i, t in enumerate(texts)], "doc_id long, text string, row int, v string, n int")
    got = {r.doc_id: r for r in chosen_path.near_duplicates(docs).collect()}
    assert {i: r.component_id for i, r in got.items()} == dict(enumerate(want))
    assert all(got[i].n_shingles == len(s) and got[i].kept == (want[i] == i) for i, s in enumerate(sets))


def test_nodes_are_branched_once(spark, monkeypatch):
    """What makes several rows of a class runs once for each level, not once for each reader."""
    monkeypatch.setattr(chosen_path, "LEAF", 6)
    monkeypatch.setattr(chosen_path, "DEPTH", 4)
    made = []

    def watched(df, name):
        made.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("Generate ")))
        return staged(df, name)

    monkeypatch.setattr(chosen_path, "staged", watched)
    docs = spark.createDataFrame(list(enumerate(near_texts(6))), "doc_id long, text string")
    chosen_path.near_duplicates(docs).count()
    assert sum(n for _, n in made) >= 3 and max(n for _, n in made) == 1


def test_near_duplicates_at_half(spark):
    assert chosen_path.trees(75) == 10 and chosen_path.agreeing(75) == 74
    words = [[f"w{i}x{k}" for k in range(100)] for i in range(30)]
    texts = [" ".join(w) for w in words] + [" ".join(w[:62] + ["n"] * 5 + w[:20]) for w in words]
    sets = plain_sets(texts)
    assert all(0.5 <= len(a & b) / len(a | b) < 0.6 for a, b in zip(sets[:30], sets[30:]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in chosen_path.near_duplicates(docs, similarity=50).collect()}
    assert got == {i: i % 30 for i in range(60)}


def test_near_duplicates_repeated_null_and_empty(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A b c d e f"), (5, "other words of the same id"), (None, "x y z"), (None, None), (7, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in chosen_path.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 2, 3, False), (5, 2, 3, False), (3, 2, 3, True), (5, 2, 5, True), (None, 1, 7, False), (None, 0, None, True), (7, 1, 7, True)], key=str)
    assert sorted(r.doc_id or 0 for r in chosen_path.keep_one(docs).collect()) == [0, 3, 5, 7]
    assert chosen_path.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_of_repeated_rows_shared_and_null_ids(spark):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join(words), " ".join(words[:-1] + ["other"])]
    rows = [(1, near[0]), (1, near[0]), (1, near[1]), (4, near[1]), (None, "p q r s t u"), (None, "P q r s t u"), (None, "p q r s t u"),
            (8, "e f g"), (8, "e f g"), (9, "l m n"), (None, None), (None, "")]
    got = [r.doc_id for r in chosen_path.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([1, None, 8, 9, None, None], key=str)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, i) for i in range(201, 400)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(250)]
    df = spark.createDataFrame(edges + edges[:50] + [(1000, 1000)], "a long, b long")
    want = groups(1001, edges)
    got = {r.vertex: r.root for r in components.components(df).collect()}
    assert got == {v: want[v] for e in edges if e[0] != e[1] for v in e}
    assert components.components(df.limit(0)).count() == 0


# --- lines --------------------------------------------------------------------

def plain_lines(texts, similarity=line_dedup.SIMILARITY, width=line_dedup.WIDTH):
    places = [(i, k, t.strip(" ").encode()) for i, text in enumerate(texts) if text is not None for k, t in enumerate(text.split("\n"))]
    places = [p for p in places if len(p[2]) >= line_dedup.LEAST_BYTES]
    sets = [{b[i:i + width] for i in range(len(b) - width + 1)} for _, _, b in places]
    links = [(x, y) for x in range(len(places)) for y in range(x) if 100 * len(sets[x] & sets[y]) >= similarity * len(sets[x] | sets[y])]
    first = groups(len(places), links)
    drop = {}
    for x, r in enumerate(first):
        if r != x:
            drop.setdefault(places[x][0], []).append(places[x][1])
    return drop


@pytest.mark.parametrize("leaf", [24, 4])
def test_lines_equal_plain(spark, monkeypatch, leaf):
    monkeypatch.setattr(line_dedup, "LEAF", leaf)
    monkeypatch.setattr(line_dedup, "KEYS", 12)
    rng = random.Random(7)
    vocab = vocabulary(rng)
    pool = [" ".join(rng.choices(vocab, k=rng.randrange(3, 60))) for _ in range(25)] + ["x" * 3000, "ab " * 400, "日本語のテキスト" * 12]
    texts = [None, "", "\n\n", "short\nshort"]
    for _ in range(70):
        own = []
        for _ in range(rng.randrange(1, 6)):
            if rng.random() < 0.6:
                line = rng.choice(pool)
                own.append(" ".join(edited(rng, line.split(" "), rng.randrange(0, 3), vocab)))
            else:
                own.append(" ".join(rng.choices(vocab, k=rng.randrange(1, 40))))
        texts.append("\n".join(own))
    drop = plain_lines(texts)
    docs = spark.createDataFrame([Row(doc_id=i, text=t, row="r", line=1, v=2) for i, t in enumerate(texts)], "doc_id long, text string, row string, line int, v int")
    out = line_dedup.dedup_lines(docs, dropped_col="gone")
    assert out.columns == docs.columns + ["gone"] and line_dedup.dedup_lines(docs).columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(texts)
    assert {i: r.gone for i, r in got.items() if r.gone} == drop
    for i, t in enumerate(texts):
        want = t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop.get(i, ()))
        assert got[i].text == want


def test_lines_repeated_rows_and_empty(spark):
    line = "a line that is long enough to be compared with other lines"
    docs = spark.createDataFrame([(2, line), (2, line), (1, line + "\n" + line), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect()), key=str)
    assert got == sorted([(2, ""), (2, ""), (1, line), (None, None)], key=str)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_lines_in_large_bands_are_found(spark):
    """Every passage is in half of the lines, so every band is far larger than LEAF; pairs share 9 of 10 passages."""
    rng = random.Random(11)
    pool = ["".join(rng.choices("abcdefghijklmnop", k=99)) + " " for _ in range(20)]
    lines = []
    for _ in range(150):
        chosen = rng.sample(range(20), 11)
        lines += ["".join(pool[i] for i in sorted(chosen[:10])), "".join(pool[i] for i in sorted(chosen[1:]))]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.dedup_lines(docs, dropped_col="gone").collect() if r.gone}
    want = plain_lines(lines)
    assert len(want) >= 140 and gone <= set(want) and len(gone) >= 0.993 * len(want)


def test_edited_lines_of_ordinary_length(spark):
    """One character replaced in mid-line from 40 characters on, one word of five from 60 on, in any script."""
    rng = random.Random(12)
    lines, edits = [], []
    for alphabet in ("abcdefghijklmnop", "дежзиклмнопрстуф", "あいうえおかきくけこさしすせそた"):
        for n in range(40, 121, 4):
            words = "".join("".join(rng.choices(alphabet, k=5)) + " " for _ in range(n // 6 + 1))[:n - 1] + alphabet[0]
            lines.append(words)
            edits.append(words[:n // 2] + "7" + words[n // 2 + 1:])
            if n >= 60:
                at = n // 12 * 6
                lines.append(alphabet[1] + words)
                edits.append(alphabet[1] + words[:at] + "90214" + words[at + 5:])
    k = len(lines)
    docs = spark.createDataFrame(list(enumerate(lines + edits)), "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.dedup_lines(docs, dropped_col="gone").collect() if r.gone}
    assert set(range(k, 2 * k)) <= gone


def test_short_lines_that_repeat_go(spark):
    docs = spark.createDataFrame([(1, "Share\n\nok\r\n\r\nRead more"), (2, "Read more\nok\r\n\r\n\nno"), (3, " Share \n日本\n日本語"),
                                  (4, "日本\n本日\nx")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: "Share\n\nok\r\n\r\nRead more", 2: "\r\n\nno", 3: "日本\n日本語", 4: "本日\nx"}


def test_sketches_refuse_long_unlike_lines(spark):
    """The union of two unlike lines of 600 units fills a sketch, which tells that they are unlike; similar ones pass."""
    rng = random.Random(13)
    lines, near = [], []
    for n in (120, 600, 690, 1500, 2600, 2900):
        line = "".join(rng.choices("abcdefghijklmnop", k=n))
        lines += [line, line[:n // 12] + "7" * (n // 12) + line[n // 6:]]
        near.append((len(lines) - 2, len(lines) - 1))
    for n, longer in ((690, 760), (2700, 2950)):  # the longer one is sketched by every 4th of its shingles only
        line = "".join(rng.choices("abcdefghijklmnop", k=longer))
        lines += [line[:n], line]
        near.append((len(lines) - 2, len(lines) - 1))
    rows = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate(lines)], "v long, b binary")
    made = line_dedup._sketches(rows, 70)
    pairs = made.alias("x").join(made.alias("y"), F.col("x.v") < F.col("y.v")).where(line_dedup._may_be_similar("x", "y", 70))
    sets = plain_shingles(lines)
    assert all(len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]) for a, b in near)
    assert sorted(tuple(r) for r in pairs.select("x.v", "y.v").collect()) == near


def test_tasks_hold_few_bytes_of_long_texts_at_a_time(spark, tmp_path):
    """Batches of texts end after some bytes, between the reader and the rows as well as on the way to Python."""
    import pyarrow as pa

    from riskline.llm import common
    spark.range(0, 1000, 1, 1).select(F.repeat(F.col("id").cast("string"), 10000).alias("text")).write.parquet(str(tmp_path / "long"))
    common.prepare(spark)
    texts = spark.read.parquet(str(tmp_path / "long"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])
    got = texts.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 1000 and max(r.size for r in got) <= 2 * common.SLICE_BYTES
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 256


def test_bounds_of_the_sketches_drop_pairs_that_cannot_be_similar_and_no_others(spark):
    """Pairs of similarity 0.45 to 0.95, long ones too: the bounds keep all from 0.7 on, and few far below it."""
    rng = random.Random(5)
    lines = []
    for n in (40, 150, 400, 690, 1500, 6000):
        for share in (3, 5, 8, 11, 14, 17, 20, 23, 26, 30):
            line = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
            cut = n * share // 100
            lines += [line, "".join(rng.choices("0123456789", k=cut)) + line[cut:]]
    rows = spark.createDataFrame([(i, bytearray(x.encode())) for i, x in enumerate(lines)], "v long, b binary")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, len(lines), 2)], "a long, b long")
    sets = plain_shingles(lines)
    alike = {i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, len(lines), 2)}
    similar = {i for i, s in alike.items() if s >= 0.7}
    search = line_dedup._Search(rows, rows, 70)
    finer = {r.a for r in search.finer(pairs, rows).collect()}
    assert similar <= finer and len(finer - similar) <= 6 and max(len(lines[i]) for i in set(alike) - finer) == 6000
    made = line_dedup._sketches(rows, 70)
    coarse = pairs.join(made.alias("x"), F.col("a") == F.col("x.v")).join(made.alias("y"), F.col("b") == F.col("y.v"))
    coarse = {r.a for r in coarse.where(line_dedup._may_be_similar("x", "y", 70)).select("a").collect()}
    short = {i for i in alike if len(lines[i]) <= 150}
    assert similar <= coarse and all(alike[i] >= 0.62 for i in coarse & short)  # 0.5 by the estimate alone


def plain_shingles(lines, width=line_dedup.WIDTH):
    return [{t[i:i + width] for i in range(len(t) - width + 1)} for t in lines]


def test_prefixes_tell_small_hashes_apart(spark):
    """Hashes of a signature are all near the least long."""
    df = spark.range(5000).select((F.lit(-2**63) + F.col("id") * 2**30).alias("node"))
    wanted = df.limit(20)
    assert 20 <= line_dedup._may_hold(df, "node", wanted).count() < 400


def test_staged_leaves_no_shuffle_files(spark, tmp_path):
    import glob
    import time

    def shuffled():
        local = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
        return {f for d in local for f in glob.glob(f"{d}/*/shuffle_*")}

    before, key = shuffled(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    out = staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "no-shuffle-files")
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 7 and spark.conf.get(key, None) == was


# --- importance ---------------------------------------------------------------

def plain_grams(text):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+|[^\s0-9a-z\x80-\U0010ffff]+", (text or "").translate(LOWER), re.ASCII)
    return words + list(zip(words, words[1:]))


def test_importance_equals_plain(spark):
    rng = random.Random(6)
    good, bad = vocabulary(rng, 25), vocabulary(rng, 25)
    texts = [" ".join(rng.choices(good if i % 3 else bad + ["%%", "!!"], k=rng.randrange(1, 40))) for i in range(200)] + [None, "", "  "]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, kept="k", id=1) for i, t in enumerate(texts)], "doc_id long, text string, kept string, id int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 150)] + [(None, 1), (9999, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in importance.resample(docs, labels, F.col("quality") == 1, share=0.5, buckets=1 << 22).collect()}
    assert len(got) == len(texts)
    target, raw = {}, {}
    for i, t in enumerate(texts):
        for g in plain_grams(t):
            raw[g] = raw.get(g, 0) + 1
            if i < 150 and i % 3:
                target[g] = target.get(g, 0) + 1
    n_t, n_r = sum(target.values()), sum(raw.values())
    size, s = 1 << 22, importance.SMOOTHING
    for i, t in enumerate(texts):
        want = sum(math.log((target.get(g, 0) + s * n_t / size) / (n_t * (1 + s))) - math.log((raw[g] + s * n_r / size) / (n_r * (1 + s))) for g in plain_grams(t))
        assert got[i].n_grams == len(plain_grams(t)) and math.isclose(got[i].log_weight, want, abs_tol=1e-6)
    keys = sorted((r.gumbel_key for r in got.values()), reverse=True)
    assert sum(r.kept for r in got.values()) == round(0.5 * len(texts)) and all(r.kept == (r.gumbel_key >= keys[round(0.5 * len(texts)) - 1]) for r in got.values())
    assert np.mean([got[i].kept for i in range(200) if i % 3]) > 0.6 > 0.2 > np.mean([got[i].kept for i in range(0, 200, 3)])


def test_importance_query_draws_the_target_share(spark, tmp_path):
    from riskline.llm.queries import QUERIES
    spark.createDataFrame([(i, f"word{i} of text {i * 7}") for i in range(200)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2), int(i % 10 == 1)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert QUERIES["op1_importance_resampling"](spark, str(tmp_path)).where("kept").count() == 80  # 40 of 100 labelled


def test_importance_without_labels_and_ties(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = importance.resample(docs, none, F.col("quality") == 1).collect()
    assert [(r.log_weight, r.kept) for r in got] == [(0.0, True)] * 3
    assert importance.resample(docs.limit(0), none, F.col("quality") == 1, share=0.5).count() == 0
    one = [r for r in importance.resample(docs, none, F.col("quality") == 1, share=0.5).collect() if r.doc_id == 1]
    assert one[0].kept == one[1].kept


@pytest.mark.parametrize("k", [1, 7, 500, 999, 1000])
def test_kth_largest(spark, monkeypatch, k):
    monkeypatch.setattr(importance, "SORTED_KEYS", 3)
    rng = random.Random(k)
    values = [rng.choice([rng.randrange(-2**63, 2**63 - 1), rng.randrange(-5, 5), 2**62 + rng.randrange(300)]) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    assert importance.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(df, "x", 1001) is None


def test_doubles_in_order():
    x = np.array([-np.inf, -1e9, -1.0, -1e-300, -0.0, 0.0, 1e-300, 0.5, 2.0, np.inf])
    assert (np.diff(importance._ordered(x)) >= 0).all() and importance._ordered(np.array([-0.0]))[0] == importance._ordered(np.array([0.0]))[0]


# --- pipeline -----------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    rng = random.Random(8)
    vocab = vocabulary(rng)
    base = [" ".join(rng.choices(vocab, k=60)) for _ in range(8)]
    near = " ".join(edited(rng, base[0].split(), 1, vocab))
    item = " ".join(rng.choices(vocab, k=20))
    texts = base + [near, "12 34", None, " ".join(rng.choices(vocab, k=60)) + " " + item, "a line of its own that is long enough, yes\n" + base[2]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    step = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, str(tmp_path)).cache()
        kept.append({r.doc_id for r in step.collect()})
        assert step.columns[:5] == docs.columns and (name.startswith("SentencePiece") or step.columns == docs.columns)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert kept[0] == set(range(13)) - {9, 10}
    assert kept[1] == kept[0] - {8}  # its one line is nearly that of 0
    assert kept[3] == kept[2] - {11}
    assert all(r.exact and r.n_pieces > 0 for r in step.collect())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in whole.collect()} == kept[-1]


def test_items_digest_is_of_sorted_names(spark):
    got = spark.range(1).select(F.sha2(F.array_join(F.array(), ","), 256)).first()[0]
    assert got == hashlib.sha256(b"").hexdigest()
