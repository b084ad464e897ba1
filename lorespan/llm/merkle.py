"""A Merkle manifest of a dataset by time-forward processing: digests travel up by node label, proofs travel back down."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespan.llm.common import stored

#: Children of a node, and levels that one task climbs at once: a block is the tree below ``ARITY ** CLIMB`` nodes.
ARITY, CLIMB = 16, 3
BLOCK = ARITY**CLIMB

_PROOF = "array<struct<before:string,after:string>>"
_PROOF_TYPE = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def field(value: Column) -> Column:
    """A value as it stands in a leaf: byte count, colon, decimal or text; ``-`` if null."""
    written = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(written).cast("string"), F.lit(":"), written), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """The digest of a row of these values, as lower-case hex."""
    return F.sha2(F.concat(*map(field, values)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda acc, level: F.sha2(F.concat(level["before"], acc, level["after"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof, level by level and left to right, as one text of digests."""
    return F.array_join(F.transform(proof, lambda level: F.concat(level["before"], level["after"])), "")


def parents(total: int) -> int:
    return -(-total // ARITY)


def _digest(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def sweep_up(digests: Sequence[str], total: int) -> list[tuple[tuple[int, int], list[str]]]:
    """The nodes above the nodes of one block, in the order of their labels ``(level, index)``, with their children.

    ``total`` nodes stand on the block's lowest level in the whole tree: it ends where one is left. A priority queue
    holds the digests under way to their parents; the node with the smallest label is next, and has all its children
    by then.
    """
    queue = [(1, k // ARITY, k, d) for k, d in enumerate(digests)] if total > 1 else []
    made, level_total = [], [total]
    while queue:
        level, index = queue[0][:2]
        children = []
        while queue and queue[0][:2] == (level, index):
            children.append(heapq.heappop(queue)[3])
        made.append(((level, index), children))
        if len(level_total) == level:
            level_total.append(parents(level_total[-1]))
        if level < CLIMB and level_total[level] > 1:
            heapq.heappush(queue, (level + 1, index // ARITY, index, _digest(children)))
    return made


def sweep_down(made: list[tuple[tuple[int, int], list[str]]], suffix: list) -> list[list]:
    """The proofs of the nodes of a block from ``suffix``, the proof of its topmost node: the sweep reversed.

    Nodes are taken by descending label; each hands its own proof to its children, every child's siblings before it.
    """
    proofs = {made[-1][0]: suffix} if made else {}
    for (level, index), children in reversed(made):
        proof = proofs.pop((level, index))
        for k in range(len(children)):
            proofs[level - 1, index * ARITY + k] = [("".join(children[:k]), "".join(children[k + 1 :])), *proof]
    return [proofs[0, k] for k in range(len(proofs))]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows that come sorted by ``keys``, with the places where groups begin and end."""
    wait: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if wait is None else pa.concat_tables([wait, rows])
        starts = _starts(rows, keys)
        if len(starts) > 1:
            yield rows.slice(0, int(starts[-1])), starts
        wait = rows.slice(int(starts[-1])) if len(starts) else wait
    if wait is not None and len(wait):
        yield wait, np.array([0, len(wait)])


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(len(rows), bool)
    change[:1] = True
    for k in keys:
        values = rows[k].to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, cuts in _groups(batches, ["tree", "block"]):
        digests, totals = rows["digest"].to_pylist(), rows["total"].to_pylist()
        trees, blocks = rows["tree"].to_pylist(), rows["block"].to_pylist()
        out = []
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            made, total = sweep_up(digests[i:j], totals[i]), totals[i]
            for _ in range(made[-1][0][0]):
                total = parents(total)
            out.append((trees[i], blocks[i], total, _digest(made[-1][1])))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["tree", "idx", "total", "digest"])


def _down(carried: int):
    """Messages and nodes of each block in, nodes with their proofs out; the first row of a block is its message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in _groups(batches, ["tree", "block"]):
            digests, totals = rows["digest"].to_pylist(), rows["total"].to_pylist()
            heads = rows.take(pa.array(cuts[:-1]))
            suffixes, tops = heads["proof"].to_pylist(), heads["tops"]
            proofs = []
            for suffix, i, j in zip(suffixes, cuts[:-1].tolist(), cuts[1:].tolist()):
                above = [(s["before"], s["after"]) for s in suffix]
                proofs += sweep_down(sweep_up(digests[i + 1 : j], totals[i + 1]), above) if totals[i + 1] > 1 else [above]
            node = np.ones(len(rows), bool)
            node[cuts[:-1]] = False
            of = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts) - 1)
            ends = np.cumsum([0, *map(len, proofs)])
            flat = [level for proof in proofs for level in proof]
            pairs = pa.StructArray.from_arrays([pa.array([x for x, _ in flat], pa.string()), pa.array([y for _, y in flat], pa.string())], ["before", "after"])
            kept = rows.filter(pa.array(node)).combine_chunks()
            columns = [kept[c].combine_chunks() for c in ("tree", "idx", *(f"c{k}" for k in range(carried)))]
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            top = tops.take(pa.array(of)).combine_chunks()
            top = top.combine_chunks() if isinstance(top, pa.ChunkedArray) else top
            proof = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([*columns, proof, top], ["tree", "idx", *(f"c{k}" for k in range(carried)), "proof", "tops"])

    return run


def ordered(rows: DataFrame, group: str | None, *by: Column) -> DataFrame:
    """``rows`` with ``idx`` (place in the group by ``by``, from 0) and ``total`` (rows of the group).

    Rows are dealt by ranges of group and order, sorted there and numbered; only one row per range and group is added
    up. A group of any size is spread over ranges; a null group is a group.
    """
    own = F.lit(0).alias("of") if group is None else F.col(group).alias("of")
    keys = [F.col(group).asc_nulls_first()] if group else []
    order = [*keys, *by, F.col("salt")]
    # Equal rows are told apart, so that they do not all fall into one range.
    dealt = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt").withColumn("at", F.monotonically_increasing_id())
    dealt = stored(dealt.select("*", own), "ordered").withColumn("range", F.shiftright("at", 33))
    runs = dealt.groupBy("of", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("of").alias("run_of"),
        F.col("range").alias("run_range"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(Window.partitionBy("of")).alias("total"),
    )
    same = F.col("of").eqNullSafe(F.col("run_of")) & (F.col("range") == F.col("run_range"))
    found = dealt.join(runs, same).withColumn("idx", F.col("at") + F.col("shift"))
    return found.drop("at", "of", "range", "run_of", "run_range", "shift")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Stored rounds of ``tree, idx, total, digest``: the lowest nodes, then the tops of their blocks, and so on to the roots.

    The queue of a block lives in its task; what leaves a block waits in the next round's shuffle, sorted by tree and
    index, so no queue outgrows a block. The driver sees the size of the largest tree alone.
    """
    rounds = [nodes]
    most = nodes.agg(F.max("total")).first()[0] or 0
    while most > 1:
        open_ = rounds[-1].where("total > 1").select("tree", "idx", "total", "digest", F.expr(f"idx div {BLOCK}").alias("block"))
        dealt = open_.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
        rounds.append(stored(dealt.mapInArrow(_up, "tree long, idx long, total long, digest string"), "nodes"))
        for _ in range(CLIMB):
            most = parents(most)
    return rounds


def roots(rounds: list[DataFrame]) -> DataFrame:
    """``tree, digest`` of the root of every tree."""
    found = [r.where("total = 1").select("tree", "digest") for r in rounds]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def descend(rounds: list[DataFrame], above: DataFrame, carried: list[str]) -> DataFrame:
    """``tree, idx, proof, tops`` and the ``carried`` columns of the lowest nodes, from the top round down.

    ``above`` has ``tree, proof, tops``: the proof of each tree's own root in what stands above it, and digests that
    all its leaves are given. A block receives one message, the proof of its topmost node, which comes before its
    nodes in the order of labels; proofs grow level by level inside the tasks and are shuffled for blocks alone.
    """
    message = None
    for level in range(len(rounds) - 1, -1, -1):
        own = carried if level == 0 else []
        nodes = rounds[level]
        kinds = [nodes.schema[c].dataType.simpleString() for c in own]
        block = F.when(F.col("total") > 1, F.expr(f"idx div {BLOCK}")).otherwise(0).alias("block")
        tops = nodes.where("total = 1").select("tree").join(above, "tree").select("tree", F.lit(0).cast("long").alias("block"), "proof", "tops")
        given = tops if message is None else tops.union(message.select("tree", F.col("idx").alias("block"), "proof", "tops"))
        empty = [F.lit(None).cast(k).alias(f"c{n}") for n, k in enumerate(kinds)]
        nothing = [F.lit(None).cast(k).alias(c) for c, k in (("proof", _PROOF), ("tops", "array<string>"))]
        given = given.select("tree", "block", F.lit(-1).cast("long").alias("idx"), F.lit(0).cast("long").alias("total"), F.lit("").alias("digest"), "proof", "tops", *empty)
        held = nodes.select("tree", block, "idx", "total", "digest", *nothing, *[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(own)])
        both = given.union(held).repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
        schema = ["tree long", "idx long", *[f"c{n} {k}" for n, k in enumerate(kinds)], f"proof {_PROOF}", "tops array<string>"]
        message = both.mapInArrow(_down(len(own)), ", ".join(schema))
        if level:
            message = stored(message, "proofs")
    return message.select("tree", "idx", "proof", "tops", *[F.col(f"c{n}").alias(c) for n, c in enumerate(carried)])


def manifest(leaves: DataFrame, by: str = "doc_id", source: str = "source", leaf: str = "leaf") -> DataFrame:
    """``leaves`` with ``subroot``, ``root`` and ``proof`` of every row.

    ``leaves`` are small rows: an order column, a group, the leaf's digest and whatever else shall come back. Rows of a
    group stand by ``by`` (null first; rows of equal id by their digest, so equal rows are equal leaves side by side);
    groups by their value, null first and bytewise. Every ``ARITY`` consecutive nodes become their digest while several
    remain; a lone leaf is its own subroot, a lone subroot the root. ``proof`` lists for each level the siblings before
    and after, as texts of joined digests (empty for an only child). An empty table gives an empty manifest. Columns
    called ``subroot``, ``root`` or ``proof`` are replaced; no other name clashes.
    """
    kept = [c for c in leaves.columns if c not in ("subroot", "root", "proof")]
    rows = leaves.select(
        F.col(source).alias("source"), F.col(by).alias("by"), F.col(leaf).alias("digest"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("own")
    )
    placed = stored(ordered(rows, "source", F.col("by").asc_nulls_first(), F.col("digest")), "leaves")
    sources = stored(ordered(placed.select("source").distinct(), None, F.col("source").asc_nulls_first()), "sources")
    named = sources.select(F.col("source").alias("named"), F.col("idx").alias("tree"))
    lowest = placed.join(named, F.col("source").eqNullSafe(F.col("named"))).select("tree", "idx", "total", "digest", "own")
    rounds = climb(stored(lowest, "nodes"))
    subroots = stored(roots(rounds), "subroots")
    size = sources.select(F.col("idx").alias("at"), "total")
    upper = subroots.join(size, F.col("tree") == F.col("at")).select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "total", "digest")
    above = climb(stored(upper, "nodes"))
    start = roots(above).select("tree", F.lit(None).cast(_PROOF).alias("none"), F.array("digest").alias("tops"))
    start = start.select("tree", F.coalesce("none", F.array().cast(_PROOF)).alias("proof"), "tops")
    outer = descend(above, start, []).select(F.col("idx").alias("of"), "proof", "tops")
    outer = outer.join(subroots, F.col("of") == F.col("tree")).select("tree", "proof", F.concat(F.array("digest"), "tops").alias("tops"))
    found = descend(rounds, stored(outer, "proofs"), ["own"])
    own = [F.col(f"own.`{c}`").alias(c) for c in kept]
    return found.select(*own, F.col("tops")[0].alias("subroot"), F.col("tops")[1].alias("root"), "proof")


def op11_merkle_manifest(spark, root: str) -> DataFrame:
    """Leaf, roots, proof digest and the root that every (partly tampered) document folds to."""
    docs = spark.read.parquet(f"{root}/documents.parquet")
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    leaf = leaf_digest(*values, F.col("text"))
    rows = docs.select("doc_id", "source", leaf.alias("leaf"), F.when(tampered, leaf_digest(*values, lowered)).alias("other"))
    found = manifest(stored(rows, "digests"))
    found = found.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("proof")))
    proof = F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql() -> str:
    """The query by a join per level: enough levels for a million documents a source and 4,096 sources."""
    text = lambda x: f"coalesce(strlen({x}::varchar)::varchar || ':' || {x}::varchar, '-')"
    fields = " || ".join(map(text, ("doc_id", "source", "lang", "n_chars")))
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "list_concat([4294967295], flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0])))"
    crc = f"xor(list_reduce({bits}, lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295)"
    parts = [
        f"d as (select doc_id, source, sha256({fields} || {text('text')}) as leaf, coalesce({crc} % 5 = 0, false) as bad, "
        f"sha256({fields} || {text(lowered)}) as other from documents)",
        "n0 as (select source as g, row_number() over (partition by source order by doc_id) - 1 as i, count(*) over (partition by source) as c, leaf as h from d)",
        "p0 as (select doc_id, source as g, row_number() over (partition by source order by doc_id) - 1 as i, case when bad then other else leaf end as acc, '' as proof from d)",
    ]

    def level(n: str, p: str, k: int) -> None:
        now, then = f"{n}{k}", f"{n}{k + 1}"
        parts.append(
            f"{then} as (select g, case when c > 1 then i // 16 else i end as i, case when c > 1 then (c + 15) // 16 else c end as c, "
            f"case when c > 1 then sha256(string_agg(h, '' order by {now}.i)) else min(h) end as h from {now} group by g, c, case when c > 1 then {now}.i // 16 else {now}.i end)"
        )
        parts.append(
            f"{p}{k + 1} as (select q.doc_id, q.g, case when min(t.c) > 1 then q.i // 16 else q.i end as i, "
            f"case when min(t.c) > 1 then sha256(coalesce(string_agg(t.h, '' order by t.i) filter (t.i < q.i), '') || q.acc || "
            f"coalesce(string_agg(t.h, '' order by t.i) filter (t.i > q.i), '')) else q.acc end as acc, "
            f"q.proof || case when min(t.c) > 1 then coalesce(string_agg(t.h, '' order by t.i) filter (t.i <> q.i), '') else '' end as proof "
            f"from {p}{k} q join {now} t on t.g is not distinct from q.g and (t.i // 16 = q.i // 16) group by q.doc_id, q.g, q.i, q.acc, q.proof)"
        )

    for k in range(5):
        level("n", "p", k)
    parts.append("u0 as (select 0 as g, row_number() over (order by g nulls first) - 1 as i, count(*) over () as c, h from n5)")
    parts.append("names as (select g as source, row_number() over (order by g nulls first) - 1 as i, h from n5)")
    parts.append("v0 as (select doc_id, 0 as g, names.i, acc, proof from p5 join names on source is not distinct from p5.g)")
    for k in range(3):
        level("u", "v", k)
    return (
        f"with {', '.join(parts)} select d.doc_id, d.leaf, names.h as subroot, u3.h as root, sha256(v3.proof) as proof_sha256, v3.acc as folded_root, v3.acc = u3.h as verified "
        "from d join names on names.source is not distinct from d.source join v3 on v3.doc_id = d.doc_id cross join u3"
    )


SQL = _sql()
