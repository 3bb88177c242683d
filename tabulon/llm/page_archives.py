"""The pages table as WARC archives with revisit records, and what reading them back gives."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.files import delete, fresh
from tabulon.llm import warc
from tabulon.llm.common import written

#: Payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000


def _record_id(page_id, digest, row):
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), digest, F.lit(":"), row)


def _page_id(record_id):
    return F.expr(f"try_cast(split_part({record_id}, ':', 3) as long)")


def _with_rows(pages: DataFrame) -> DataFrame:
    """``pages`` with ``__row``: the place of each row in the files they come from; other tables are written first."""
    place = F.concat_ws("-", F.hex(F.xxhash64("_metadata.file_path")), "_metadata.row_index").alias("__row")
    try:
        return pages.select("*", place)
    except AnalysisException:
        return written(pages, "pages")[0].select("*", place)


def archived(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, from archives that hold them.

    Of pages with equal long payloads that with the largest page_id is a response, the others revisit
    it.  A page without an id is always a response.  Repeated rows are kept, each as a record of its
    own with the same type.  Both facts of a revisit are its response's; they are null where the
    archives don't give the payload back.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = _with_rows(pages.select("page_id", "url", "html"))
    rows = rows.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("uri"), payload.alias("payload"), "__row")
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = (F.octet_length("payload") >= REVISIT_BYTES) & F.col("page_id").isNotNull()
    kept = rows.where(long).groupBy("digest").agg(F.max(F.struct("page_id", "__row")).alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    kept, kept_path = written(kept, "kept-payloads")
    marked = rows.join(kept, "digest", "left")
    refers = F.when(long & (F.col("page_id") != F.col("keeper.page_id")), _record_id(F.col("keeper.page_id"), F.col("digest"), F.col("keeper.__row")))
    path = fresh(spark, "warc")
    warc.write_archives(marked.select(_record_id(F.col("page_id"), F.col("digest"), F.col("__row")).alias("record_id"), "uri", "payload", "digest", refers.alias("refers_to")), path)

    read = warc.read_archives(spark, path).where("type in ('response', 'revisit')")
    facts = read.select("record_id", "type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(F.col("payload").isNotNull(), F.col("digest")).alias("payload_digest"))
    facts, _ = written(facts, "records")
    response = facts.where("type = 'response'")
    revisit = facts.where("type = 'revisit'").drop("payload_bytes", "payload_digest")
    # Both sides of the join come from files, so that adaptive execution can split a payload with many revisits.
    asked = revisit.select(F.col("refers_to").alias("record_id")).distinct()
    first, _ = written(response.join(asked, "record_id", "left_semi").select(F.col("record_id").alias("refers_to"), "payload_bytes", "payload_digest"), "revisited")
    delete(spark, path, kept_path)
    both = response.unionByName(revisit.join(first, "refers_to", "left").select(*facts.columns))
    return both.select(_page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), _page_id("refers_to").alias("refers_to"))
