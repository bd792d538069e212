"""A Merkle manifest of a dataset: one digest for all of it, and for each row a proof that it belongs to it.

Each row is a leaf. The leaves of a source, in order of doc_id, are hashed in runs of ARITY until one digest, the
source's subroot, remains; the subroots in order of source likewise give the root. The tree is cut into aligned blocks of
ARITY ** LEVELS leaves, so that a block is a subtree of known height whatever lies beside it. Each block is
walked in postorder in one task: the walk returns a subtree's digest, and while it unwinds appends the siblings of
the subtree to the path of each leaf in it. The blocks' roots are the leaves of the next, LEVELS higher, distributed walk.
Paths are then put together from the top down, by joins on the block.

Texts are hashed where they are read and never shuffled: what moves is a row's ids and digests. Places come from
ranges of the sorted rows and their counts, so a source may hold any share of the rows.

Nulls: a null column is ``-`` in its leaf; a null source is a source of its own and comes first; null ids come first and
are not tampered with. Rows of one doc_id stand in order of their leaf, equal rows in any order. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .work import saved, sized_broadcast

ARITY = 3
#: Height of a block: a task holds ARITY ** LEVELS leaves at a time.
LEVELS = 6
#: Rows of block roots or sources, with their paths, that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 10_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<l:string,r:string>>"


def digest(*values: Column) -> Column:
    """Lowercase hex sha256 of the values: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    part = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*(part(v.cast("string")) for v in values)), 256)


def walk(digests: list[str], height: int, paths: list[list[tuple[str, str]]], lo: int = 0) -> str:
    """The digest of the subtree of this height whose first leaf is lo.

    Each leaf below gets, lowest level first, what stands left and right of it in its run.
    """
    if not height:
        return digests[lo]
    step, end = ARITY ** (height - 1), min(len(digests), lo + ARITY**height)
    starts = range(lo, end, step)
    own = [walk(digests, height - 1, paths, a) for a in starts]
    for i, a in enumerate(starts):
        beside = ("".join(own[:i]), "".join(own[i + 1 :]))
        for leaf in range(a, min(a + step, end)):
            paths[leaf].append(beside)
    return hashlib.sha256("".join(own).encode()).hexdigest()


def height_of(n: int, levels: int) -> int:
    """Levels to one digest over n leaves, or ``levels`` where the tree goes on above the block."""
    height = 0
    while ARITY**height < n and height < levels:
        height += 1
    return height


def _with(rows: DataFrame, more: str) -> StructType:
    """The columns of rows and some more."""
    return StructType(rows.schema.fields + StructType.fromDDL(more).fields)


def _numbered(batches):
    """Add the partition and the number of the row within its partition and mk_key; rows come sorted."""
    part, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        nth = []
        for key in batch.column("mk_key").to_pylist():
            n = n + 1 if key == last else 0
            last = key
            nth.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(nth), pa.int32()), pa.array(nth, pa.int64())], [*batch.schema.names, "mk_part", "mk_nth"])


def _placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes with mk_pos, their place within mk_key by ``order``, and mk_n, the key's number of nodes."""
    ranged = nodes.repartitionByRange("mk_key", *order).sortWithinPartitions("mk_key", *order)
    ranked = saved(ranged.mapInArrow(_numbered, _with(nodes, "mk_part int, mk_nth long")), "ranked")
    sizes = ranked.groupBy("mk_key", "mk_part").agg((F.max("mk_nth") + 1).alias("size"))
    by = Window.partitionBy("mk_key").orderBy("mk_part")
    before = F.coalesce(F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("size").over(Window.partitionBy("mk_key"))
    starts = saved(sizes.select("mk_key", "mk_part", before.alias("before"), total.alias("mk_n")), "starts")
    rows = ranked.join(sized_broadcast(starts, starts.count(), BROADCAST_ROWS), ["mk_key", "mk_part"])
    return rows.withColumn("mk_pos", F.col("before") + F.col("mk_nth")).drop("before", "mk_part", "mk_nth")


def _walker(levels: int):
    """Walk the blocks of rows sorted by mk_key and mk_pos; add each row's path in its block and the block's digest."""
    size = ARITY**levels
    path_type = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        block = pa.concat_batches(held)
        digests = block.column("mk_digest").to_pylist()
        paths: list[list[tuple[str, str]]] = [[] for _ in digests]
        top = walk(digests, height_of(block.column("mk_n")[0].as_py(), levels), paths)
        return pa.RecordBatch.from_arrays([*block.columns, pa.array(paths, path_type), pa.array([top] * len(digests))], [*block.schema.names, "mk_path", "mk_top"])

    def run(batches):
        held, last = [], None
        for batch in batches:
            marks = list(zip(batch.column("mk_key").to_pylist(), (p // size for p in batch.column("mk_pos").to_pylist()), strict=True))
            lo = 0
            for i, mark in enumerate(marks):
                if mark != last:
                    held += [batch.slice(lo, i - lo)] if i > lo else []
                    if held:
                        yield done(held)
                    held, lo, last = [], i, mark
            held.append(batch.slice(lo))
        if held:
            yield done(held)

    return run


def _walked(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes(mk_key, mk_pos, mk_n, mk_digest, ...) with mk_block, mk_path within the block and mk_top, its digest."""
    rows = nodes.withColumn("mk_block", F.expr(f"mk_pos div {ARITY**levels}"))
    sorted_ = rows.repartition("mk_key", "mk_block").sortWithinPartitions("mk_key", "mk_pos")
    return saved(sorted_.mapInArrow(_walker(levels), _with(rows, f"mk_path {PATH}, mk_top string")), "walked")


def tree(nodes: DataFrame, order: list[str], levels: int = LEVELS) -> DataFrame:
    """nodes(mk_key, mk_digest, order..., others) with mk_path, their siblings up to the root of mk_key, and mk_root, that root."""
    size = ARITY**levels
    rounds = [_walked(_placed(nodes, order), levels)]
    while rounds[-1].where(f"mk_n > {size}").limit(1).count():
        roots = rounds[-1].where(f"mk_n > {size} and mk_pos % {size} = 0")
        rounds.append(_walked(roots.select("mk_key", F.col("mk_block").alias("mk_pos"), F.expr(f"(mk_n + {size - 1}) div {size}").alias("mk_n"), F.col("mk_top").alias("mk_digest")), levels))
    above = None
    for rows in reversed(rounds):
        if above is not None:
            up = above.select("mk_key", F.col("mk_pos").alias("mk_block"), F.col("mk_path").alias("up"), F.col("mk_root").alias("up_root"))
            rows = rows.join(sized_broadcast(up, up.count(), BROADCAST_ROWS), ["mk_key", "mk_block"], "left")
            rows = rows.withColumn("mk_path", F.concat("mk_path", F.coalesce("up", F.array().cast(PATH)))).withColumn("mk_root", F.coalesce("up_root", "mk_top")).drop("up", "up_root")
        else:
            rows = rows.withColumn("mk_root", F.col("mk_top"))
        above = rows
    return above.drop("mk_pos", "mk_n", "mk_block", "mk_top")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["l"], acc, x["r"]), 256))


def manifest(docs: DataFrame, tampered: tuple[Column, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), a row a document.

    ``tampered`` is (whether a row is changed, its changed text); folded_root is then made of the changed leaf.
    """
    changed, text = tampered or (F.lit(False), F.col("text"))
    leaf = digest(*(F.col(c) for c in FIELDS))
    again = F.when(F.coalesce(changed & ~F.equal_null(text, F.col("text")), F.lit(False)), digest(*(F.col(c) for c in FIELDS[:-1]), text))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    leaves = docs.select("doc_id", key.alias("mk_key"), leaf.alias("mk_digest"), again.alias("mk_other"), F.monotonically_increasing_id().alias("mk_row"))
    rows = tree(saved(leaves, "leaves"), ["doc_id", "mk_digest", "mk_row"], levels)
    rows = saved(rows, "paths")
    subroots = saved(rows.groupBy("mk_key").agg(F.first("mk_root").alias("mk_digest")), "subroots")
    top = tree(subroots.select(F.lit("").alias("mk_key"), F.col("mk_key").alias("mk_source"), "mk_digest"), ["mk_source"], levels)
    top = saved(top.select(F.col("mk_source").alias("mk_key"), F.col("mk_path").alias("up"), F.col("mk_root").alias("root")), "top")
    rows = rows.join(sized_broadcast(top, top.count(), BROADCAST_ROWS), "mk_key").withColumn("path", F.concat("mk_path", "up"))
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["l"], x["r"])), ""), 256)
    rows = rows.select("doc_id", F.col("mk_digest").alias("leaf"), F.col("mk_root").alias("subroot"), "root", proof.alias("proof_sha256"), folded(F.coalesce("mk_other", "mk_digest"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents; where 2 divides the CRC of the doc_id, the copy that is checked has lost its line feeds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(docs, (changed, F.replace(F.col("text"), F.lit("\n"), F.lit(""))))


def _oracle() -> str:
    part = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    head = " || ".join(part(c) for c in FIELDS[:-1])
    bit = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END"
    byte = f"list_reduce(list_prepend(xor(crc, ascii(ch)::BIGINT), range(8)), lambda c, i: {bit})"
    crc = f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda crc, ch: {byte.replace('ascii(ch)::BIGINT', 'ch')}))"
    climb = lambda name, leaves: f"""
{name} AS (SELECT k, 0 AS lv, i, d, n FROM {leaves} UNION ALL
  SELECT k, lv + 1, i // {ARITY}, sha256(string_agg(d, '' ORDER BY i)), (n + {ARITY - 1}) // {ARITY} FROM {name} WHERE n > 1 GROUP BY k, lv, i // {ARITY}, n)"""  # noqa: E731
    path = lambda name, leaves, nodes: f"""
{name} AS (SELECT a.k, a.i, b.lv, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (WHERE b.i < a.i // {ARITY}**b.lv), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (WHERE b.i > a.i // {ARITY}**b.lv), '') AS r
  FROM {leaves} a JOIN {nodes} b ON a.k = b.k AND b.n > 1 AND b.i // {ARITY} = a.i // {ARITY}**(b.lv + 1) GROUP BY a.k, a.i, b.lv)""".replace(f"{ARITY}**b.lv", f"CAST(pow({ARITY}, b.lv) AS BIGINT)").replace(f"{ARITY}**(b.lv + 1)", f"CAST(pow({ARITY}, b.lv + 1) AS BIGINT)")  # noqa: E731
    return f"""
WITH RECURSIVE hashed AS (SELECT doc_id, coalesce('s' || source, '') AS k, sha256({head} || {part('text')}) AS d,
  CASE WHEN {crc} % 2 = 0 THEN sha256({head} || {part("replace(text, chr(10), '')")}) END AS other FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM hashed),{climb('nodes', 'leaves')},
subs AS (SELECT k, d FROM nodes WHERE n = 1),
subleaves AS (SELECT '' AS k, k AS source_, d, row_number() OVER (ORDER BY encode(k)) - 1 AS i, count(*) OVER () AS n FROM subs),{climb('above', 'subleaves')},{path('low', 'leaves', 'nodes')},{path('high', 'subleaves', 'above')},
steps AS (SELECT k, i, lv, l, r FROM low UNION ALL SELECT a.k, a.i, 1000 + h.lv, h.l, h.r FROM leaves a JOIN subleaves s ON s.source_ = a.k JOIN high h ON h.i = s.i),
paths AS (SELECT k, i, list(struct_pack(l := l, r := r) ORDER BY lv) AS p FROM steps GROUP BY k, i),
whole AS (SELECT doc_id, a.k, d AS leaf, coalesce(other, d) AS used, coalesce(p, []) AS p FROM leaves a LEFT JOIN paths USING (k, i)),
fold AS (SELECT *, list_reduce(list_prepend(struct_pack(l := '', r := used), p), lambda acc, x: struct_pack(l := '', r := sha256(x.l || acc.r || x.r))).r AS folded_root FROM whole)
SELECT doc_id, leaf, subs.d AS subroot, top.d AS root, sha256(list_aggregate(list_prepend('', list_transform(p, lambda x: x.l || x.r)), 'string_agg', '')) AS proof_sha256, folded_root, folded_root = top.d AS verified
FROM fold JOIN subs USING (k) CROSS JOIN (SELECT d FROM above WHERE n = 1) top
"""


ORACLE_SQL = _oracle()
