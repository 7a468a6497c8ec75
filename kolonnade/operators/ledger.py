"""Append-only decision ledger: latest decisions, pending work, validation, error streaks, compiled graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kolonnade.functions.keys import ident

#: Error classes, and words in an error text without a class, that mean the service failed, not the answer.
API_CLASSES = ("HTTP", "TIMEOUT")
API_WORDS = ("timeout", "urlerror", "http error", "connection refused", "connection reset", "quota")
DECISIONS = ("ADD_EDGE", "REJECT")


def api_error(error_class: Column, error: Column) -> Column:
    named = F.coalesce(error_class, F.lit(""))
    text = F.lower(F.coalesce(error, F.lit("")))
    word = F.lit(False)
    for w in API_WORDS:
        word = word | text.contains(w)
    return F.when(named != "", F.upper(named).startswith("API_") | F.upper(named).isin(*API_CLASSES)).otherwise(word)


def latest(ledger: DataFrame, ok_only: bool) -> DataFrame:
    """The last row of each candidate by position, of its OK rows if `ok_only`: (candidate, n_rows, seq, status, decision, confidence, error_class, error).

    Identifiers compare stripped and in lower case; rows without one are left out; equal positions are equal
    rows. Partial aggregates, so a candidate with very many rows costs one row a task.
    """
    rows = ledger.select(ident(F.col("candidate_id")).alias("candidate"), F.col("ingest_seq").alias("seq"), "status", F.col("parsed_payload.decision").alias("decision"), F.col("parsed_payload.confidence").alias("confidence"), "error_class", "error").where("candidate is not null")
    rows = rows.where("status = 'OK'") if ok_only else rows
    names = ("status", "decision", "confidence", "error_class", "error")
    last = rows.groupBy("candidate").agg(F.count("*").alias("n_rows"), F.max(F.struct("seq", *names)).alias("x"))
    return last.select("candidate", "n_rows", "x.seq", *[f"x.{n}" for n in names])


def skipped(ledger: DataFrame, policy: str) -> DataFrame:
    """(candidate): those a resumed run leaves out: `ok_only` with an OK row, `any_record` with any, `primary_sweep` also those whose last row is no service error."""
    if policy == "any_record":
        return latest(ledger, False).select("candidate")
    ok = latest(ledger, True).select("candidate")
    if policy == "ok_only":
        return ok
    if policy != "primary_sweep":
        raise ValueError(f"unknown policy {policy}")
    settled = latest(ledger, False).where(~api_error(F.col("error_class"), F.col("error"))).select("candidate")
    return ok.unionByName(settled).distinct()


def pending(queue: DataFrame, ledger: DataFrame, policy: str) -> DataFrame:
    """Queue rows (candidate, ...) that a resumed run still has to do."""
    return queue.join(skipped(ledger, policy), "candidate", "left_anti")


def validation(ledger: DataFrame) -> DataFrame:
    """(seq, errors): what is wrong with each payload; rows without a payload say so."""
    p = lambda f: F.col(f"parsed_payload.{f}")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    ref = lambda s: F.concat(p(f"{s}.tab"), F.lit("."), p(f"{s}.col"))
    pair = F.array_sort(F.array(ref("col1"), ref("col2")))
    decision = F.coalesce(p("decision"), F.lit(""))
    tests = {
        "candidate_id mismatch": ~F.coalesce(ident(p("candidate_id")) == ident(F.col("candidate_id")), F.lit(False)),
        "invalid decision": ~decision.isin(*DECISIONS),
        "unordered pair mismatch": ~F.coalesce(pair == F.array_sort("pair_key"), F.lit(False)),
        "confidence must be a number in [0, 1]": ~F.coalesce(p("confidence").between(0, 1), F.lit(False)),
        "reason_summary must be a non-empty string": blank(p("reason_summary")),
        "ADD_EDGE requires non-empty ambiguity_trigger_context": (decision == "ADD_EDGE") & blank(p("ambiguity_trigger_context")),
        "REJECT requires ambiguity_trigger_context = null": (decision == "REJECT") & p("ambiguity_trigger_context").isNotNull(),
    }
    found = F.when(F.col("parsed_payload").isNull(), F.lit("missing payload")).otherwise(F.array_join(F.array_compact(F.array(*[F.when(c, t) for t, c in tests.items()])), "; "))
    return ledger.select(F.col("ingest_seq").alias("seq"), found.alias("errors")).distinct()


def json_object(c: Column) -> Column:
    """The JSON object in a text: inside a fence, else from the first to the last brace; null if none parses."""
    fenced = F.regexp_extract(c, "(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```", 1)
    braces = F.regexp_extract(c, "(?s)(\\{.*\\})", 1)
    best = F.when(fenced != "", fenced).otherwise(braces)
    return F.when(F.try_parse_json(best).isNotNull(), best)


def error_streaks(ledger: DataFrame) -> DataFrame:
    """(batch_id, n_rows, n_api_errors, streak): how many batches in a row, up to this one, failed at the service only.

    Batches are ordered by name inside their run (the part before the first hyphen); one row a batch is left
    when the order is taken.
    """
    rows = ledger.where("batch_id is not null").groupBy("batch_id").agg(F.count("*").alias("n_rows"), F.count_if(api_error(F.col("error_class"), F.col("error"))).alias("n_api_errors"))
    run = F.split("batch_id", "-")[0]
    full = F.col("n_rows") == F.col("n_api_errors")
    marked = rows.withColumn("run", run).withColumn("full", full).withColumn("grp", F.sum((~F.col("full")).cast("int")).over(W.partitionBy("run").orderBy("batch_id")))
    place = F.row_number().over(W.partitionBy("run", "grp", "full").orderBy("batch_id"))
    return marked.select("batch_id", "n_rows", "n_api_errors", F.when(F.col("full"), place).otherwise(0).alias("streak"))


def compiled(queue: DataFrame, ledger: DataFrame) -> DataFrame:
    """(candidate, outcome, decision, confidence): accepted, rejected or unresolved with the reason, from the last OK row of each queued candidate."""
    ok = latest(ledger, True).select("candidate", "decision", "confidence")
    outcome = F.when(F.col("seen").isNull(), "unresolved:no_terminal_decision").when(F.col("decision") == "ADD_EDGE", "accepted").when(F.col("decision") == "REJECT", "rejected").otherwise("unresolved:invalid_terminal_payload")
    return queue.select("candidate").distinct().join(ok.withColumn("seen", F.lit(1)), "candidate", "left").select("candidate", outcome.alias("outcome"), "decision", "confidence")


def graph_groups(edges: DataFrame) -> DataFrame:
    """(db_id, group_id, l, r, n_edges, confidence): accepted pairs as groups, numbered by pair inside a database.

    Sides compare as spelled; a missing side, a pair of one column with itself and repeated pairs drop out.
    """
    ref = lambda s: F.concat(F.col(f"{s}.tab"), F.lit("."), F.col(f"{s}.col"))
    rows = edges.select("db_id", F.least(ref("col1"), ref("col2")).alias("l"), F.greatest(ref("col1"), ref("col2")).alias("r"), "confidence", ref("col1").alias("a"), ref("col2").alias("b"))
    rows = rows.where("a is not null and b is not null and lower(a) <> lower(b)")
    per = rows.groupBy("db_id", "l", "r").agg(F.count("*").alias("n_edges"), F.max("confidence").alias("confidence"))
    number = F.row_number().over(W.partitionBy("db_id").orderBy("l", "r")) - 1
    return per.select("db_id", F.format_string("group_%06d", number).alias("group_id"), "l", "r", "n_edges", "confidence")


def graph_lookup(groups: DataFrame, anchors: DataFrame) -> DataFrame:
    """(db_id, anchor, option, group_id, rank): every group with the anchor, options ordered: anchor, same name, same table, rest."""
    sides = groups.select("db_id", "group_id", F.explode(F.array("l", "r")).alias("anchor"), F.array("l", "r").alias("options"))
    hits = sides.join(anchors.select("db_id", "anchor").distinct(), ["db_id", "anchor"]).select("db_id", "anchor", "group_id", F.explode("options").alias("option"))
    tab = lambda c: F.split(c, "\\.", 2)[0]
    col = lambda c: F.lower(F.element_at(F.split(c, "\\.", 2), 2))
    kind = F.when(F.col("option") == F.col("anchor"), 0).when(col("option") == col("anchor"), 1).when(tab("option") == tab("anchor"), 2).otherwise(3)
    order = W.partitionBy("db_id", "anchor", "group_id").orderBy("kind", F.lower("option"), "option")
    return hits.withColumn("kind", kind).withColumn("rank", F.row_number().over(order)).select("db_id", "anchor", "option", "group_id", "rank")
