"""The offline construction end to end: profile, channels, queue, decisions by a provider, compiled graph."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from kolonnade import providers
from kolonnade.operators import lexical, profile, proposals, values, vectors
from kolonnade.session import cut
from kolonnade.sources.catalog import Constraints, catalog, unpivoted

TEMPLATE = 'Could columns {l} ({l_type}) and {r} ({r_type}) be confused? Channels: {channels}. Answer as {"decision": ..., "confidence": ...}.'


def deterministic_verifier(prompts):
    """A stand-in for a verifier: accepts pairs that two channels propose."""
    return [json.dumps({"decision": "ADD_EDGE" if "," in p.partition("Channels: ")[2].partition(".")[0] else "REJECT", "confidence": 0.5}) for p in prompts]


def construct(tables: dict[str, DataFrame], studied: dict, constraints: Constraints = Constraints(), complete=deterministic_verifier, embed=providers.hashed_embedding, floor: float = 0.75) -> dict[str, DataFrame]:
    """`profile`, `queue`, `decisions` and `edges` of one database; `studied` names the columns whose values are read."""
    columns = cut(catalog({t: tables[t].select(*c) for t, c in studied.items()}, constraints))
    tally = cut(profile.tallied(unpivoted(tables, studied)))
    domain = cut(values.domains(tally))
    whole = profile.profile(tally, columns)
    names = columns.withColumn("db_id", F.lit("db"))
    lex = lexical.candidates(names)
    texts = columns.select(F.col("ref").alias("column_id"), providers.descriptive_name(F.col("col")).alias("text"))
    embedded = vectors.usable(cut(vectors.fill(texts, embed)), "column_id", "embedding")
    near = vectors.symmetric(vectors.search(embedded, embedded, floor=floor)).withColumn("candidate_id", F.concat_ws("|", "l", "r"))  # the columns of one schema are the stated queries
    collided = values.collisions(domain, columns, profile.modes(tally, columns))
    found = proposals.united([proposals.channel(lex, "lexical", "lexical_similarity"), proposals.channel(near, "surface_name_embedding", "cosine"), proposals.channel(collided, "value_collision", "overlap")])
    queue = cut(proposals.with_context(proposals.bundles(found), columns))
    asked = queue.select(F.col("candidate_id").alias("request_id"), providers.prompt(TEMPLATE.replace('{"', "\0").replace("...}", "\1"), l=F.col("l"), r=F.col("r"), l_type=F.col("l_type"), r_type=F.col("r_type"), channels=F.col("channels")).alias("prompt"))
    asked = asked.withColumn("prompt", F.translate("prompt", "\1", "}"))
    answers = cut(providers.completed(asked.withColumn("prompt", F.replace("prompt", F.lit("\0"), F.lit('{"'))), complete))
    read = F.from_json("content", "decision string, confidence double")
    decisions = answers.select(F.col("request_id").alias("candidate_id"), F.when(F.col("ok"), read).alias("x"), "error_class").select("candidate_id", "x.decision", "x.confidence", "error_class")
    edges = queue.join(decisions.where("decision = 'ADD_EDGE'"), "candidate_id").select("candidate_id", "l", "r", "channels", "confidence")
    return {"profile": whole, "queue": queue, "decisions": decisions, "edges": edges}
