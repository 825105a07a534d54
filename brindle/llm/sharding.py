"""A reproducible shuffle into shards, without sorting by random numbers.

Rows get global numbers from 0 on in the order of their id (ties: a hash of the whole row). A Feistel network, keyed by the
seed, permutes the numbers: it is a bijection on the smallest range of an even number of bits that holds them all, and a
number that comes out beyond the last row is sent through it again until it is one (cycle walking; less than four times on
average, as the range is less than four times the rows). A row's place p gives its shard, p % shards, and its slot there,
p // shards. So every reader can compute where a row went (``Feistel.forward``) and which row stands at a slot
(``Feistel.backward``) from the seed and the number of rows alone.

Numbering: one range partitioning and a sort within its partitions; what precedes a partition comes from the partitions'
counts. Equal rows are told apart by their place in a written table, so rows that are all equal, or share one id, still
spread over partitions. The numbers of equal rows are interchangeable, so the result is the same in every run.

Defined results: a null id comes first; a null text has no bytes; no rows give no rows; equal texts are spread like any
others (no group is kept together, the law is ``rows``). A column that clashes with a result comes back as ``<name>_in``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import small, table, text_or_empty, with_row_key, written
from brindle.llm.worker import tidy

SHARDS, SEED, ROUNDS = 40, 1, 6
_FACTOR, _WORD = 0x45D9F3B, 0xFFFFFFFF


def round_keys(seed: int) -> list[int]:
    return [int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16) for i in range(1, ROUNDS + 1)]


@dataclass(frozen=True)
class Feistel:
    """A permutation of 0 to rows - 1."""

    rows: int
    seed: int = SEED

    @property
    def half(self) -> int:
        """Bits of each half."""
        return max(1, -(-(self.rows - 1).bit_length() // 2))

    def _mixed(self, x: np.ndarray, key: int) -> np.ndarray:
        x = (x + key & _WORD) * _FACTOR & _WORD
        x = (x ^ x >> 16) * _FACTOR & _WORD
        return (x ^ x >> 16) & (1 << self.half) - 1

    def _through(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & (1 << self.half) - 1
        for key in reversed(round_keys(self.seed)) if back else round_keys(self.seed):
            if back:
                left, right = right ^ self._mixed(left, key), left
            else:
                left, right = right, left ^ self._mixed(right, key)
        return left << self.half | right

    def _walked(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._through(np.asarray(x, np.int64), back)
        while len(far := np.flatnonzero(out >= self.rows)):
            out[far] = self._through(out[far], back)
        return out

    def forward(self, numbers: np.ndarray) -> np.ndarray:
        return self._walked(numbers, False)

    def backward(self, places: np.ndarray) -> np.ndarray:
        return self._walked(places, True)

    def at(self, shard: int, slot: int, shards: int = SHARDS) -> int:
        """The number of the row at a slot."""
        place = slot * shards + shard
        if not 0 <= shard < shards or not 0 <= place < self.rows:
            raise IndexError(f"no slot {slot} in shard {shard}")
        return int(self.backward(np.array([place]))[0])


def numbered(df: DataFrame, id_col: str, name: str = "row_number") -> tuple[DataFrame, int]:
    """(``df`` with global row numbers from 0 on by id, number of rows). No window over all rows: sorted partitions count on
    from one another. ``df`` is written once, so that equal rows have places that stay."""
    rows = written(with_row_key(df, *df.columns).withColumn("_at", F.monotonically_increasing_id()), "rows")
    dealt = rows.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(id_col).asc_nulls_first(), "_r1", "_r2", "_at")
    ordered = dealt.sortWithinPartitions(F.col(id_col).asc_nulls_first(), "_r1", "_r2", "_at").drop("_r1", "_r2", "_at")
    local = written(ordered.withColumn("_m", F.monotonically_increasing_id()), "sorted")  # the partition above 33 bits of place
    part = F.shiftrightunsigned("_m", 33)
    sizes = local.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(sizes.select("_part", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")), "starts")
    total = starts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    out = local.withColumn("_part", part).join(small(starts.select("_part", "_start")), "_part")
    return out.withColumn(name, F.col("_start") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_part", "_start", "_m"), total


def _placed(at: int, feistel: Feistel, shards: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = feistel.forward(batch.column(at).to_numpy())
            parts = [pa.array((place % shards).astype(np.int32)), pa.array(place // shards)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *parts], names=[*batch.schema.names, "shard", "slot"])

    return run


def sharded(df: DataFrame, *, id_col: str = "doc_id", shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, Feistel]:
    """(``df`` with row_number, shard and slot, the permutation that computes them). Counts of shards differ by one at most,
    slots are gapless from 0."""
    df = df.withColumnsRenamed({c: f"{c}_in" for c in df.columns if c in ("row_number", "shard", "slot")})
    rows, total = numbered(df, id_col)
    feistel = Feistel(total, seed)
    schema = T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return rows.mapInArrow(_placed(rows.columns.index("row_number"), feistel, shards), schema), feistel


def write_shards(df: DataFrame, path: str, **how) -> Feistel:
    """The rows as Parquet, a folder ``shard=k`` each. A shard's rows are cut into ranges of slots that tasks sort on their own,
    so no task holds a whole shard; a file's rows are in the order of their slots."""
    rows, feistel = sharded(df, **how)
    a_file = 1 << 20
    dealt = rows.withColumn("_range", F.floor(F.col("slot") / a_file)).repartition("shard", "_range").sortWithinPartitions("shard", "slot").drop("_range")
    dealt.write.partitionBy("shard").parquet(path)
    return feistel


def op12_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = text_or_empty(docs, "text")
    out, _ = sharded(docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def _sql_round(x: str) -> str:
    """One round on the halves of a number: (right, left ^ mixed(right, key))."""
    right, left = f"({x} & (mask))", f"({x} >> half)"
    a = f"((({right} + key) & 4294967295) * {_FACTOR} & 4294967295)"
    b = f"(xor({a}, {a} >> 16) * {_FACTOR} & 4294967295)"
    return f"(({right} << half) | xor({left}, xor({b}, {b} >> 16) & mask))"


_SQL_THROUGH = "list_reduce(list_prepend({x}, keys), lambda x, key: " + _sql_round("x") + ")"
OP12_SQL = f"""
with recursive crc_table as materialized (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) as crc),
rows_ as materialized (
  select doc_id, octet_length(encode(coalesce(text, ''))) + 16 as size, row_number() over (order by doc_id nulls first) - 1 as row_number,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint)),
      lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])), 4294967295) as text_crc32
  from documents, crc_table),
law as materialized (
  select count(*) as total, greatest(1, ceil(length(ltrim(bin(count(*) - 1), '0')) / 2.0))::bigint as half,
    list_transform(range(1, {ROUNDS + 1}), lambda i: ('0x' || sha256('{SEED}:' || i)[1:8])::bigint) as keys from documents),
walk as (
  select row_number, {_SQL_THROUGH.format(x="row_number")} as place from (select *, (1::bigint << half) - 1 as mask from rows_, law)
  union all
  select row_number, {_SQL_THROUGH.format(x="place")} from (select *, (1::bigint << half) - 1 as mask from walk, law) where place >= total)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'rows' as law, (place % {SHARDS})::int as shard, (place // {SHARDS})::bigint as slot,
  null::int as grown_shard, row_number::bigint as row_number
from rows_ join walk using (row_number), law where place < total
"""

QUERIES = {"op12_feistel_shards": op12_feistel_shards}
SQL = {"op12_feistel_shards": OP12_SQL}
