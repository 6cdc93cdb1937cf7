"""Near-duplicate documents by chosen-path set similarity join.

A document is the set of its shingles. Equal sets are one class first. Every class gets ``COORDINATES``
minwise tokens (for each of that many hash functions the shingle with the least hash). A tree branches
the classes by tokens: a root deals them out by one coordinate's token, and a node that holds more than
``LEAF`` classes is branched again by one or two further coordinates, chosen by the node's own hash, so
that a class that shares its path shares its choices. Two sets of similarity s agree on a coordinate
with probability s; independent roots, as many as the threshold needs, bring the recall at it to the target.
That counts whole root nodes; a pair that meets only in nodes large enough to be branched can be lost there.

In every root's node each class is first compared with the node's centre (the class with the most company
over all nodes), which links most copies without comparing all pairs. Nodes whose classes are by then in
one component are done; large ones are branched, small ones compared exhaustively across components, each node in
one task, and what is still large at the deepest level is compared with its centres and then in pairs of blocks. Comparisons
pass a filter on sizes and on agreeing bytes of ``SKETCH`` minwise tokens and are then confirmed on the full sets,
computed from the texts.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskline.llm.common import BitTable, discard, having, prepare, slices, staged, text_buffer
from riskline.llm.components import components
from riskline.llm.words import NONSPACE, gram_hashes, mix, word_hashes

SHINGLE = 5
#: Similarity in hundredths.
SIMILARITY = 75
COORDINATES = 32
#: At the threshold a pair stays apart in all roots with this probability at most.
MISSED = 1e-6
LEAF = 1024
DEPTH = 8
#: Hash functions of a class's sketch, a byte of each one's token; the first ``COORDINATES`` make the paths.
SKETCH = 128
#: A pair is confirmed if its agreeing bytes are this many standard deviations below the threshold's mean at least.
DEVIATIONS = 4.5

_SEEDS = mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def trees(similarity: int) -> int:
    """Roots for a threshold in hundredths; below 0.36 ``COORDINATES`` are too few for the target."""
    apart = 1 - similarity / 100
    return min(COORDINATES, math.ceil(math.log(MISSED) / math.log(apart))) if 0 < apart < 1 else 1 if apart <= 0 else COORDINATES


def agreeing(similarity: int) -> int:
    """Agreeing bytes of a sketch that a pair needs to be confirmed; 74 at 0.75."""
    s = similarity / 100
    return max(0, round(SKETCH * s - DEVIATIONS * math.sqrt(SKETCH * s * (1 - s))))


def shingle_sets(words: np.ndarray, first: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle of all of them."""
    grams = gram_hashes(words, width)
    out = []
    for begin, end in zip(first[:-1].tolist(), first[1:].tolist()):
        n = end - begin
        if n >= width:
            h = np.sort(grams[begin:end - width + 1])
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
        else:
            out.append(gram_hashes(words[begin:end], n) if n else np.zeros(0, np.uint64))
    return out


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """For each non-empty set the least mixed hash under each function: (sets, SKETCH)."""
    out = np.zeros((len(sets), SKETCH), np.uint64)
    if sets:
        flat = np.concatenate(sets)
        begins = np.cumsum([0] + [len(s) for s in sets[:-1]])
        for k, seed in enumerate(_SEEDS):
            x = flat * seed
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            out[:, k] = np.minimum.reduceat(x, begins)
    return out


def sketches(rows: DataFrame, width: int) -> DataFrame:
    """(id, row, text) as (id, row, n, c1, c2, tokens, sketch): the set's size, its class (two hashes), minwise
    tokens and the sketch's bytes, eight to a long."""
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words, first = word_hashes(*text_buffer(part.column(2)), NONSPACE)
                sets = shingle_sets(words, first, width)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                tokens = _signatures([sets[i] for i in full])
                c = np.zeros((2, len(sets)), np.uint64)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    begins = np.cumsum(np.concatenate([[0], n[full][:-1]]))
                    c[0, full] = np.add.reduceat(mix(flat), begins)
                    c[1, full] = np.add.reduceat(mix(flat ^ np.uint64(0xA0761D6478BD642F)), begins)
                sketch = tokens.astype(np.uint8).view(np.int64)
                lists = []
                for values in (tokens[:, :COORDINATES].view(np.int64), sketch):
                    ends = np.zeros(len(sets) + 1, np.int32)
                    ends[1:] = np.cumsum(np.where(n > 0, values.shape[1], 0))
                    lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel())))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n), pa.array(c[0].view(np.int64)),
                     pa.array(c[1].view(np.int64)), *lists], ["id", "row", "n", "c1", "c2", "tokens", "sketch"])

    return rows.mapInArrow(run, f"id {id_type}, row bigint, n bigint, c1 bigint, c2 bigint, tokens array<bigint>, "
                                "sketch array<bigint>")


def _agreeing(a: str, b: str) -> Column:
    """Bytes of two sketches that agree."""
    differ = F.lit(0)
    for s in range(SKETCH // 8):
        x = F.get(f"{a}.sketch", F.lit(s)).bitwiseXOR(F.get(f"{b}.sketch", F.lit(s)))
        for k in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return F.lit(SKETCH) - differ


class _Block:
    """The classes that meet in a node or in two blocks of it, in one task."""

    def __init__(self, table: pa.Table, similarity: int):
        self.v, self.root, self.own, self.n = (table.column(c).to_numpy() for c in ("v", "root", "own", "n"))
        i, j = (table.column(c)[0].as_py() if len(self.v) else 0 for c in ("i", "j"))
        self.one, self.two = self.own == i, self.own == j
        sketch = table.column("sketch").combine_chunks().flatten().to_numpy()
        self.sketch = np.ascontiguousarray(sketch).view(np.uint8).reshape(len(self.v), SKETCH)
        self.alike, self.similarity = i == j, similarity

    def candidates(self):
        """(k, others): classes that may be linked with class k by size and sketch, of another component; each pair once."""
        least = agreeing(self.similarity)
        for k in np.flatnonzero(self.one).tolist():
            other = self.two & (self.root != self.root[k])
            if self.alike:
                other[:k + 1] = False
            small, large = np.minimum(self.n, self.n[k]), np.maximum(self.n, self.n[k])
            others = np.flatnonzero(other & (small * 100 >= large * self.similarity))
            if len(others):
                others = others[(self.sketch[others] == self.sketch[k]).sum(axis=1) >= least]
                if len(others):
                    yield k, others


class _Join:
    """The join over one table of documents."""

    def __init__(self, rows: DataFrame, classes: DataFrame, width: int, similarity: int):
        self.rows, self.classes, self.width, self.similarity = rows, classes, width, similarity
        self.sketch = classes.select("v", "n", "sketch")
        self.edges: DataFrame | None = None
        self.tested: DataFrame | None = None
        self.roots: DataFrame | None = None

    def fits(self, a: str, b: str) -> Column:
        small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
        return (small * 100 >= large * self.similarity) & (_agreeing(a, b) >= agreeing(self.similarity))

    def filtered(self, pairs: DataFrame) -> DataFrame:
        """Distinct (a, b), a < b, whose sizes and sketches allow the similarity."""
        pairs = pairs.distinct()
        x = pairs.join(self.sketch.alias("x"), F.col("a") == F.col("x.v")).join(
            self.sketch.alias("y"), F.col("b") == F.col("y.v"))
        return x.where(self.fits("x", "y")).select("a", "b")

    def confirm(self, pairs: DataFrame) -> None:
        """Add the pairs that reach the similarity on full sets to the edges and bring the components up to date."""
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = staged(pairs, "pairs")
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        wanted = pairs.select("a").union(pairs.select("b")).distinct().toDF("row")
        if wanted.isEmpty():
            return
        texts = having(self.rows.select("row", "text"), "row", BitTable.of(wanted, "row")).dropDuplicates(["row"])
        both = pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("left")), "a").join(
            texts.select(F.col("row").alias("b"), F.col("text").alias("right")), "b")
        width, similarity = self.width, self.similarity

        def run(batches):
            kept: dict[int, np.ndarray] = {}
            for batch in batches:
                for part in slices(batch, "right"):
                    a, b = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("a", "b"))
                    for side, ids in (("left", a), ("right", b)):
                        column = part.column(part.schema.get_field_index(side))
                        new = list({i: k for k, i in enumerate(ids) if i not in kept}.items())
                        for begin in range(0, len(new), 64):
                            some = new[begin:begin + 64]
                            words, first = word_hashes(*text_buffer(column.take(pa.array([k for _, k in some]))), NONSPACE)
                            kept.update(zip([i for i, _ in some], shingle_sets(words, first, width)))
                    same = []
                    for i, j in zip(a, b):
                        x, y = kept[i], kept[j]
                        common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                        same.append(100 * common >= similarity * (len(x) + len(y) - common))
                    mask = pa.array(same)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).filter(mask), pa.array(b, pa.int64()).filter(mask)], ["a", "b"])
                    if sum(map(len, kept.values())) > 4_000_000:
                        kept = {}

        self.join_links(both.select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint"))

    def rooted(self, nodes: DataFrame) -> DataFrame:
        """Nodes with each class's component."""
        if self.roots is None:
            return nodes.withColumn("root", F.col("v"))
        known = self.roots.select(F.col("vertex").alias("v"), F.col("root").alias("r"))
        return nodes.join(known, "v", "left").select("node", "v", F.coalesce("r", "v").alias("root"))

    def open_nodes(self, nodes: DataFrame) -> DataFrame:
        """(node, v, root, size) of the nodes that hold more than one component."""
        placed = staged(self.rooted(nodes), "placed")  # read twice: a node's children are made once
        open_ = placed.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).where(
            "lo <> hi").select("node", "size")
        out = staged(placed.join(open_, "node"), "nodes")
        discard(placed)
        return out

    def with_centres(self, nodes: DataFrame) -> DataFrame:
        """Pairs of every class with its node's centre, across components."""
        company = nodes.groupBy("v").agg(F.sum("size").alias("company"))
        ranked = nodes.join(company, "v")
        centre = ranked.groupBy("node").agg(F.max("company").alias("company")).join(
            ranked.select("node", "company", "v", "root"), ["node", "company"]).groupBy("node").agg(
            F.min("v").alias("c"), F.min_by("root", "v").alias("c_root"))
        return nodes.join(centre, "node").where("root <> c_root").select(F.least("v", "c").alias("a"), F.greatest("v", "c").alias("b"))

    def within(self, leaves: DataFrame) -> None:
        """Links across components in nodes of ``LEAF`` classes, and in pairs of blocks of larger ones.

        Pairs never become rows: a block's classes meet in one task, first by their sketches alone, which leaves the
        classes that may have a partner there, then these by the sets of their texts; a link that joins what other
        links of the block have joined already is not looked at."""
        blocks = F.ceil(F.col("size") / (LEAF // 2))
        own = F.when(F.col("size") <= LEAF, F.lit(0)).otherwise(F.pmod(F.xxhash64("v", F.lit("block")), blocks)).cast("long")
        many = F.when(F.col("size") <= LEAF, F.lit(1)).otherwise(blocks).cast("long")
        rows = leaves.select("node", "v", "root", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("other"))
        rows = rows.select("node", "v", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(
            self.sketch, "v")
        similarity, width = self.similarity, self.width

        def partners(table: pa.Table) -> pa.Table:
            held = _Block(table, similarity)
            some = np.zeros(len(held.v), bool)
            for k, others in held.candidates():
                some[k] = True
                some[others] = True
            return table.filter(pa.array(some))

        schema = "v bigint, node bigint, root bigint, own bigint, i bigint, j bigint, n bigint, sketch array<bigint>"
        rows = rows.select("v", "node", "root", "own", "i", "j", "n", "sketch").groupBy("node", "i", "j").applyInArrow(partners, schema)
        rows = staged(rows, "partners")
        wanted = rows.select(F.col("v").alias("row")).distinct()
        if wanted.isEmpty():
            return
        texts = having(self.rows.select("row", "text"), "row", BitTable.of(wanted, "row")).join(wanted, "row", "left_semi").dropDuplicates(["row"])

        def links(table: pa.Table) -> pa.Table:
            held = _Block(table, similarity)
            sets: dict[int, np.ndarray] = {}
            column = table.column("text").combine_chunks()

            def shingles(k: int) -> np.ndarray:
                if k not in sets:
                    words, first = word_hashes(*text_buffer(column.slice(k, 1)), NONSPACE)
                    sets[k] = shingle_sets(words, first, width)[0]
                return sets[k]

            root = held.root.copy()
            a, b = [], []
            for k, others in held.candidates():
                for o in others.tolist():
                    if root[k] == root[o]:
                        continue
                    x, y = shingles(k), shingles(o)
                    common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                    if 100 * common >= similarity * (len(x) + len(y) - common):
                        a.append(min(held.v[k], held.v[o]))
                        b.append(max(held.v[k], held.v[o]))
                        root[root == root[o]] = root[k]
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        found = rows.join(texts.withColumnRenamed("row", "v"), "v").groupBy("node", "i", "j").applyInArrow(links, "a bigint, b bigint")
        self.join_links(found.distinct())

    def join_links(self, found: DataFrame) -> None:
        """Add links to the edges and bring the components up to date."""
        found = staged(found, "links")
        self.edges = found if self.edges is None else self.edges.unionByName(found)
        self.roots = components(self.edges)

    def branch(self, nodes: DataFrame, depth: int) -> DataFrame:
        """Children of nodes: one coordinate each, and a second one for a third of the nodes."""
        coordinate = F.pmod(F.xxhash64("node", F.lit(depth)), F.lit(COORDINATES)).cast("int")
        second = F.pmod(coordinate + 1 + F.pmod(F.xxhash64("node", F.lit(-depth)), F.lit(COORDINATES - 1)).cast("int"), F.lit(COORDINATES))
        chosen = F.when(F.pmod(F.xxhash64("node", F.lit("two")), F.lit(3)) == 0, F.array(coordinate, second)).otherwise(F.array(coordinate))
        rows = nodes.select("node", "v").join(self.classes.select("v", "tokens"), "v")
        rows = rows.select("v", "node", "tokens", F.explode(chosen).alias("k"))
        return rows.select(F.xxhash64("node", "k", F.get("tokens", F.col("k"))).alias("node"), "v")

    def run(self) -> None:
        roots = self.classes.select("v", F.posexplode(F.slice("tokens", 1, trees(self.similarity))).alias("k", "token"))
        nodes = self.open_nodes(roots.select(F.xxhash64("k", "token").alias("node"), "v"))
        if nodes.isEmpty():
            return
        self.confirm(self.filtered(self.with_centres(nodes)))
        nodes = self.open_nodes(nodes.select("node", "v"))
        leaves = []
        for depth in range(2, DEPTH + 1):
            leaves.append(nodes.where(F.col("size") <= LEAF).select("node", "v"))
            nodes = nodes.where(F.col("size") > LEAF)
            if nodes.isEmpty():
                break
            nodes = self.open_nodes(self.branch(nodes, depth))
        else:
            leaves.append(nodes.select("node", "v"))
            large = nodes.where(F.col("size") > LEAF)
            if not large.isEmpty():
                self.confirm(self.filtered(self.with_centres(large)))
        self.within(self.open_nodes(reduce(DataFrame.unionByName, leaves)))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, similarity: int = SIMILARITY, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``id_col``, ``row`` (a hash of id and text), ``n_shingles``, ``component_id`` (the
    least id linked with it over any number of links, its own included) and ``kept`` (it has that id).

    Texts are lower-cased (A-Z) words between ASCII white space; sets hold distinct ``width``-word
    shingles; documents are linked from ``similarity`` hundredths on. Null, empty and blank texts have
    an empty set and stand alone. Repeated rows and equal texts are in one component; rows that share an
    id but not a text are separate documents; null ids name no component unless alone. Other columns are
    not read. Whole texts are used; the search is randomised, links are confirmed exactly."""
    out, component = _grouped(docs, similarity, id_col, text_col, width), F.col("component_id")
    return out.select(F.col("id").alias(id_col), "row", F.col("n").alias("n_shingles"), component,
                      F.col("id").eqNullSafe(component).alias("kept"))


def _grouped(docs: DataFrame, similarity: int, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, row, n, component_id, root) of every row; the root names the component, null for an empty set."""
    spark = docs.sparkSession
    prepare(spark)
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.select(id_.alias("id"), F.xxhash64(id_.cast("string"), text).alias("row"), text.alias("text"))
    made = staged(sketches(rows, width), "sketches")
    classes = staged(made.where("n > 0").groupBy("n", "c1", "c2").agg(
        F.min("row").alias("v"), F.min("id").alias("least"), F.first("tokens").alias("tokens"),
        F.first("sketch").alias("sketch")), "classes")
    join = _Join(rows, classes, width, similarity)
    join.run()
    if join.roots is None:
        named = classes.select("n", "c1", "c2", F.col("least").alias("component_id"), F.col("v").alias("root"))
    else:
        placed = classes.select("n", "c1", "c2", "v", "least").join(
            join.roots.select(F.col("vertex").alias("v"), "root"), "v", "left").withColumn("root", F.coalesce("root", "v"))
        least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
        named = placed.join(least, "root").select("n", "c1", "c2", "component_id", "root")
    out = made.select("id", "row", "n", "c1", "c2").join(named, ["n", "c1", "c2"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", "row", "n", component.alias("component_id"), "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, the first by id (null ids last), then row hash;
    all columns. Of rows with that row's id and text one stays. Texts without a word all stay."""
    found = staged(_grouped(docs, SIMILARITY, id_col, text_col, SHINGLE).where("n > 0").groupBy("root", "id", "row").count(), "grouped")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    stays = found.join(first.select("root", F.col("first.row").alias("stays")), "root")
    single = F.col("row") == F.col("stays")
    gone = stays.where(~single | (F.col("count") > 1)).select(F.col("row").alias("_row")).distinct()
    again = stays.where(single & (F.col("count") > 1)).select(F.col("row").alias("_row")).distinct()
    row = F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`"))
    once = docs.join(gone, row == F.col("_row"), "left_anti")
    return once.unionByName(docs.join(again, row == F.col("_row")).dropDuplicates(["_row"]).drop("_row"))
