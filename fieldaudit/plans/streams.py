"""Queries over file streams that stop halfway and go on from their checkpoint."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldaudit.plans import sql
from fieldaudit.plans.stored import folder
from fieldaudit.sources.tables import cases
from fieldaudit.streaming import arrived, file_stream, first_arrivals, validated


def in_two_runs(spark, name, rows, through):
    """Rows arrive in two deliveries of several files; the stream is started anew for the second one with the checkpoint of the first.

    The number of files grows with the rows, so that a file does not; all but one of a delivery make its first batch.
    """
    files = max(4, rows.rdd.getNumPartitions())
    source, out, checkpoint = (folder(spark, f"{name}-{part}") for part in ("in", "out", "checkpoint"))
    for delivery in (0, 1):
        rows.where(F.pmod(F.xxhash64("image_id"), F.lit(2)) == delivery).repartition(files).write.mode("append").parquet(source)
        stream = through(file_stream(spark, source, rows.schema, files_a_batch=files - 1))
        arrived(stream, out, checkpoint)
    return spark.read.schema(stream.schema).parquet(out)


def stream_rules(spark, d):
    """Rule verdicts of arriving cases, row for row those of the case table."""
    rows = cases(spark, d).select("image_id", "doc_type", F.col("ocr_id").alias("identifier"), F.col("ocr_name").alias("name"))
    return in_two_runs(spark, "rules", rows, lambda s: validated(s).select("image_id", F.col("rule.overall").alias("verdict")))


def stream_first_seen(spark, d):
    """Printed names that arrive for the first time; the state outlives the restart."""
    rows = cases(spark, d).select("image_id", "print_name")
    return in_two_runs(spark, "names", rows, lambda s: first_arrivals(s.select("print_name"), ["print_name"]))


QUERIES = {"stream_rules": stream_rules, "stream_first_seen": stream_first_seen}

_c = sql.with_(sql.cases())
ORACLES = {
    "stream_rules": f"{_c} select image_id, rule_ocr_verdict as verdict from cases",
    "stream_first_seen": f"{_c} select distinct print_name from cases",
}
