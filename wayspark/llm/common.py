"""Helpers shared by the training-data operators: shared-folder tables, word splitting, let-bindings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspark.storage import shared_dir, written

__all__ = ["among", "arrow_rows", "ascii_lower", "fold_in", "free_name", "let", "shared_dir", "table", "words", "written"]

#: White space of the contracts: space and \x09-\x0D.
SPACES = r"[ \t-\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows up to which a model or fingerprint side is broadcast; a larger side is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Arrow batches of documents stay small, so that batches of very long texts fit a worker.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def arrow_rows(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and nothing else."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once; a plain column would be computed anew for each element
    of a lambda that uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column, separator: str = SPACES) -> Column:
    """The non-empty pieces between separators; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separator), lambda w: w != "")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fold_in(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def among(rows: DataFrame, uid: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``uid`` is in the column of that name of ``ids``; both come of one ``monotonically_increasing_id``.

    Such ids are dense, so the wanted ones are a bit each in words of 64, which are broadcast (some 4 MB for ten million), and wide rows
    stay where they are."""
    word, bits = free_name(rows, "id_word"), free_name(rows, "id_bits")
    at = F.shiftright(uid, 6)
    wanted = ids.select(uid).repartition(at).groupBy(at.alias(word)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{uid}` & 63 as int))")).alias(bits))
    held = F.expr(f"shiftright(`{bits}`, cast(`{uid}` & 63 as int)) & 1") == 1
    return rows.join(F.broadcast(wanted), (at == F.col(word)) & held, "left_semi")
