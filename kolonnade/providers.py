"""Language models and embeddings as row-wise providers: any callable on a batch of texts.

Calls run where the rows lie, in batches; a failing request fails alone and comes back with its class of
error. Resuming asks only for what a ledger does not hold yet.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

Complete = Callable[[Sequence[str]], Sequence[str]]


class ResponseError(Exception):
    """The service answered with an error of its own."""


class ResponseDecodeError(Exception):
    """The service's answer can't be read."""


def error_class(e: BaseException) -> str:
    """The class under which a failed call is booked; all but a content that doesn't parse are failures of the service and asked again."""
    name = type(e).__name__.lower()
    if isinstance(e, (ResponseDecodeError, KeyError, IndexError, TypeError)):
        return "API_RESPONSE_PROTOCOL_ERROR"
    if isinstance(e, ResponseError):
        return "API_RESPONSE_ERROR"
    if "http" in name or "status" in name:
        return "API_HTTP_ERROR"
    if isinstance(e, OSError):
        return "API_TRANSPORT_ERROR"
    return "PARSER_ERROR" if isinstance(e, ValueError) else "API_CLIENT_ERROR"


def completed(requests: DataFrame, complete: Complete, batch: int = 16, attempts: int = 2) -> DataFrame:
    """(request_id, content, ok, error_class, error, elapsed_s) for requests (request_id, prompt).

    A batch that fails is tried again text by text, each `attempts` times in all.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(text: str) -> tuple[str | None, BaseException | None]:
            last: BaseException | None = None
            for _ in range(attempts):
                try:
                    return complete([text])[0], None
                except Exception as e:  # noqa: BLE001 - booked with the request
                    last = e
            return None, last

        for f in frames:
            for at in range(0, len(f), batch):
                part, began = f.iloc[at : at + batch], time.time()
                try:
                    got = [(x, None) for x in complete(part["prompt"].tolist())]
                    if len(got) != len(part):
                        raise ValueError("another number of answers than prompts")
                except Exception:  # noqa: BLE001 - each request is tried by itself
                    got = [one(t) for t in part["prompt"]]
                spent = (time.time() - began) / len(part)
                yield pd.DataFrame(
                    {
                        "request_id": part["request_id"].to_numpy(), "content": [x for x, _ in got], "ok": [e is None for _, e in got],
                        "error_class": [None if e is None else error_class(e) for _, e in got], "error": [None if e is None else str(e) for _, e in got], "elapsed_s": spent,
                    }
                )

    return requests.select("request_id", "prompt").mapInPandas(run, "request_id string, content string, ok boolean, error_class string, error string, elapsed_s double")


def resumed(requests: DataFrame, ledger: DataFrame, complete: Complete, batch: int = 16) -> DataFrame:
    """Answers to the requests without an ok row in the ledger (request_id, ok)."""
    return completed(requests.join(ledger.where("ok").select("request_id").distinct(), "request_id", "left_anti"), complete, batch)


def prompt(template: str, **columns: Column) -> Column:
    """A template with `{name}` places filled by columns; null columns leave the place empty, unknown places are an error."""
    parts = re.split(r"\{(\w+)\}", template)
    unknown = set(parts[1::2]) - set(columns)
    if unknown:
        raise ValueError(f"no column for {', '.join(sorted(unknown))}")
    return F.concat(*[F.coalesce(columns[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def descriptive_name(c: Column) -> Column:
    """A readable form of an identifier without a model: words split and lower case."""
    spaced = F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), "[_\\-.]+", " ")
    return F.lower(F.trim(F.regexp_replace(spaced, "\\s+", " ")))


def hashed_embedding(texts: Sequence[str], size: int = 64) -> list[list[float]]:
    """A stand-in for an embedding service: signed counts of hashed character trigrams; equal texts, equal vectors."""
    out = []
    for t in texts:
        v = [0.0] * size
        padded = f"  {t.lower()}  "
        for i in range(len(padded) - 2):
            h = int.from_bytes(hashlib.blake2b(padded[i : i + 3].encode(), digest_size=8).digest(), "big")
            v[h % size] += 1.0 if h >> 63 else -1.0
        out.append(v)
    return out
