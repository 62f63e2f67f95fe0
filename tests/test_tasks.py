"""Tasks from interactions: which rows, and that a mail is parsed once for them."""

from pyspark.sql import functions as F

from contactmill.operators import extraction, merge


def talks(spark, rows):
    docs = spark.createDataFrame(rows, "record_id long, lead_id long, raw_text string").repartition(3, "record_id")
    docs = extraction.extract_email_message(docs, "raw_text", "parsed")
    return merge.emit_interactions(docs.select(
        "record_id", "lead_id", F.lit("email").alias("source_type"), "raw_text",
        F.lit("2024-01-02").cast("timestamp").alias("arrived"), F.col("parsed.interaction").alias("interaction"),
    ))


ROWS = [
    (1, 7, "From: a@b.co\nSubject: News\nPlease let me know."), (2, 7, "From: a@b.co\nSubject: Dates\nby 2024-03-01, thanks"),
    (3, 7, "Subject: Nothing\nSee you"), (4, None, "Subject: No lead\nPlease let me know."), (5, 7, None), (6, 8, ""), (2, 7, "Subject: Again\n1/2/2024"),
]


def test_tasks_of_mails(spark):
    got = merge.emit_tasks(talks(spark, ROWS)).select("raw_source_id", "lead_id", "title", "due_date", "priority", "status").collect()
    assert sorted(map(tuple, got)) == [
        (1, 7, "Reply to email", None, "high", "open"), (2, 7, "Again", "1/2/2024", "normal", "open"), (2, 7, "Dates", "2024-03-01", "normal", "open"),
    ]
    plain = spark.createDataFrame(
        [(1, 1, None, "", None, None, "p"), (2, 1, None, "x", "", "", None), (3, None, True, None, None, "s", "p"), (4, 1, False, None, "n", "s", "p")],
        "raw_source_id long, lead_id long, reply_needed boolean, deadline string, next_action string, subject string, priority string",
    ).withColumn("created_at", F.lit(None).cast("timestamp"))
    assert sorted((r.raw_source_id, r.lead_id, r.title, r.due_date) for r in merge.emit_tasks(plain).collect()) == [(2, 1, "Follow up", "x"), (3, None, "s", None)]


def test_a_mail_is_parsed_once(spark):
    """The filter reads the parsed fields; it does not parse the text again, below the shuffle."""
    plan = merge.emit_tasks(talks(spark, ROWS))._jdf.queryExecution().optimizedPlan()
    filters = [line for line in plan.toString().splitlines() if "Filter" in line and "reply_needed" in line]
    assert filters and not any("raw_text" in line or "regexp" in line for line in filters)
    assert plan.toString().count("RLIKE") == 1
