"""Texts that lost their end, at a hidden length limit or in transfer.

Lengths are recomputed under several encodings (characters, UTF-8 and UTF-16 units, entity and JSON escaping,
newline conversion). Where the texts of a source pile up at one length under one of them there is a limit;
texts at it are cut unless their ending shows that they are whole. All other texts are judged by their
ending: markers of a cut, broken characters, open fences, brackets, quotes and clauses, and, for prose, whether
the last words are ones at which sentences of the corpus end. What ends a sentence is counted over all texts.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kolonnade.llm.filters import filter_of, has
from kolonnade.llm.words import Hasher, shingle_hashes
from kolonnade.session import cut

#: A limit is a length that at least this many different open-ended texts of a source reach, and this many times
#: as many as have each of the lengths before it on average; so many and so many times if longer texts follow, and
#: sources that must have a limit for it to hold in one with fewer texts. A longest length is compared with the mean
#: of those before it, a length inside with the greatest nearby.
PILE, STEEP, BEFORE = 4, 4.0, 10
INSIDE, INSIDE_STEEP = 12, 4.0
SHARED = 3
#: Share of the occurrences of the last words that must end a text for it to be whole at a limit.
FIRM = 0.9
#: Share of the occurrences of the last words that must end a text for them to be an end. Rare runs of words
#: lean on the shorter run inside them as if that had been seen `LEAN` times.
ENDING, LEAN = 0.1, 10
#: A last word is known if it was seen twice before a stop or another word, or, in fields of short values, as
#: the end of five values and of this share of all values.
KNOWN, KNOWN_ENDS, KNOWN_SHARE = 2, 5, 0.0005

_GONE = re.compile(r"[\s​⁠﻿­‌‍]+\Z")
_MARK = re.compile(r"(?:\.\.\.|…)\s*\(\d[\d,.]* more [a-z]+\)\Z|\[(?:\.\.\.|…|truncated|cut)\]\Z|<(?:truncated|cut)>\Z", re.I)
_TOKEN = re.compile(r"\w+(?:['’.]\w+)*|[.!?]+|\S")
_SQL_TOKEN = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|[\w$]+(?:\.[\w$]+)*|<=|>=|<>|!=|\S")
_SQL_START = re.compile(r"(?:\A|\n)\s*(?:select\s|with\s+\w+\s+as\s*\()", re.I)
_DIGITS = re.compile(r"\d+")
_PART = re.compile(r"\A(?=.{10,35}\Z)[0-9a-f]{8}-[0-9a-f]{0,4}(?:-[0-9a-f]{0,4}){0,2}(?:-[0-9a-f]{0,11})?\Z", re.I)
_PATH = re.compile(r"[^\W\d][\w$ ]*\w\.[^\W\d][\w$ ]*\Z")
_CLOSE = "\"'”’»)]*_"
_FIXED = re.compile(r"\A(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[-+]?\d+(?:[.,]\d+)?|\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?Z?)?)\Z", re.I)

#: Words of SQL after which a statement must go on, words that open a clause, operators.
SQL_OPEN = {"select", "distinct", "from", "where", "and", "or", "on", "join", "left", "right", "inner", "outer", "full", "cross", "group", "order", "by", "having", "limit", "union", "all", "in", "is", "not", "as", "case", "when", "then", "else", "between", "like", "with", "exists", "over", "partition", "values", "insert", "into", "update", "set", "delete"}
SQL_WORDS = SQL_OPEN | {"null", "end", "asc", "desc", "count", "sum", "avg", "min", "max", "offset", "true", "false"}
SQL_COMPARE = {"=", "<", ">", "<=", ">=", "<>", "!=", "like", "ilike", "in", "is", "between", "exists"}


def _sql(statement: str) -> tuple[bool | None, str | None]:
    """(cut, last clause): cut is None where only the corpus can tell."""
    if statement.rstrip().endswith(";"):
        return False, None
    tokens = _SQL_TOKEN.findall(statement)
    if not tokens:
        return False, None
    low = [t.lower() for t in tokens]
    if low.count("(") != low.count(")") or tokens[-1] in ("'", '"') or "'" in low or '"' in low:
        return True, None
    last = tokens[-1]
    if low[-1] in SQL_OPEN or last in "=<>,(.+-*/" or last in SQL_COMPARE or statement.rstrip()[-1:] in ".,":
        return True, None
    if low.count("case") > low.count("end"):
        return True, None
    if last.isalpha() and last.isupper() and low[-1] not in SQL_WORDS and any(w.startswith(low[-1]) for w in SQL_WORDS):
        return True, None
    clause, since, between = "select", [], 0
    for i, t in enumerate(low):
        if t == "between":
            between += 1
        if t in ("group", "order") and low[i + 1 : i + 2] != ["by"]:
            since.append(t)
        elif t in ("select", "from", "join", "on", "where", "having", "limit", "group", "order", "union", "offset") or t in ("and", "or") and clause in ("on", "where", "having"):
            if t == "and" and between:
                between -= 1
                since.append(t)
                continue
            clause, since = ("on" if t in ("and", "or") and clause == "on" else "where" if t in ("and", "or") else t), []
        else:
            since.append(t)
    if between:
        return True, None
    if clause in ("select", "join", "union"):
        return True, None
    if clause in ("where", "on", "having"):
        at = [i for i, t in enumerate(since) if t in SQL_COMPARE]
        if not at or at[-1] == len(since) - 1:
            return True, None
        if since[at[-1]] == "is" and since[-1] not in ("null", "true", "false"):
            return True, None
    if clause in ("group", "order") and (len(since) < 2 or since[0] != "by"):
        return True, None
    return None, clause


def _json_cut(body: str) -> bool:
    try:
        json.loads(body, strict=False)
        return False
    except ValueError:
        pass
    depth, inside, escaped = 0, False, False
    for ch in body:
        if inside:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                inside = False
        elif ch == '"':
            inside = True
        elif ch in "{[":
            depth += 1
        elif ch in "}]":
            depth -= 1
    return inside or depth > 0


def _mask(w: str) -> str:
    return _DIGITS.sub("0", w.lower())


def ending(text: str) -> tuple[bool | None, list[str], str | None]:
    """(cut, last words, SQL clause) of a text; cut is None where the corpus must tell."""
    t = _GONE.sub("", text)
    if not t:
        return False, [], None
    if t.endswith("\ufffd") or _MARK.search(t) or _PART.match(t):
        return True, [], None
    words = t.split()
    if t.endswith(("…", "...")) and len(words) >= 2:
        return not words[-1].startswith((".", "…")), [], None  # set apart it says "and so on"
    if t.count("```") % 2:
        return True, [], None
    if t.endswith("```"):
        return False, [], None
    at = t.lstrip("> \t")
    if at[:1] in "{[":
        return _json_cut(at), [], None
    brace = t.rfind('{"')
    if brace < 0:
        brace = t.rfind("{\n")
    if brace > 0 and _json_cut(t[brace:]):
        return True, [], None
    sql = None
    for sql in _SQL_START.finditer(t):
        pass
    if sql:
        verdict, clause = _sql(t[sql.start() :])
        if verdict is not None:
            return verdict, [], None
        last = _SQL_TOKEN.findall(t)[-1]
        return None, [_mask(last)] if last[0].isalpha() else [], clause
    if t.rstrip(_CLOSE)[-1:] in ".!?:;。！？" or t[-1] in "}]":
        return False, [], None
    if _FIXED.match(t) or len(words) < 2 and not t.isalpha() or len(words) <= 5 and _PATH.match(t):
        return False, [], None
    if len(t) < len(text) and text[len(t)] == " ":
        return True, [], None
    tail = [_mask(w) for w in _TOKEN.findall(" ".join(words[-4:]))]
    if any(w[0] in ".!?" for w in tail[-3:-1]):
        return True, [], None  # one or two words after a stop are no sentence
    return None, tail[-3:], None


_SALT = np.int64(0x5851F42D4C957F2D)


def _key(text: str) -> int:
    """A signed 64-bit key."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(text)).view(np.int64))


def _features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts with their endings: verdict, keys of the runs of last words, SQL clause, key of a value of one word."""
    hasher = Hasher()
    for f in frames:
        seen = [ending(t) for t in f["text"]]
        tails = [hasher(w) for _, w, _ in seen]
        single = [" " not in t.strip() for t in f["text"]]
        yield f.assign(
            cut=pd.array([v for v, _, _ in seen], dtype="boolean"),
            grams=[[int(shingle_hashes(h, n)[-1].view(np.int64)) for n in range(1, len(h) + 1)] for h in tails],
            clause=pd.array([c and _key("sql:" + c) for _, _, c in seen], dtype="Int64"),
            word=pd.array([_key("pre:" + w[0]) if one and v is None and w and not c else None for (v, w, c), one in zip(seen, single)], dtype="Int64"),
            open=[not (one or _FIXED.match(t.strip())) and (v if v is not None else len(w) > 0) for (v, w, _), t, one in zip(seen, f["text"], single)],
        )


class _Tokens(dict):
    """Numbers of masked words, with hash, kind (0 word, 1 stop, 2 counted end, 3 broken, 4 uncounted end) and keys of asked prefixes."""

    def __init__(self, bitmap: np.ndarray, limit: int = 500_000):
        self.bitmap, self.limit = bitmap, limit
        self.hashes: list[int] = []
        self.kinds: list[int] = []
        self.prefixes: dict[int, list[int]] = {}

    def __missing__(self, w: str) -> int:
        n = self[w] = len(self.hashes)
        masked = _mask(w)
        self.hashes.append(xxhash.xxh3_64_intdigest(masked))
        self.kinds.append(1 if w[0] in ".!?" else 2 if w == "\n" else 4 if w == "\r" else 3 if w in "…\ufffd" else 0)
        if masked.isalpha() and len(masked) > 3:
            keys = np.array([xxhash.xxh3_64_intdigest("pre:" + masked[:k]) for k in range(3, len(masked))], np.uint64)
            if len(hit := keys[has(self.bitmap, keys)]):
                self.prefixes[n] = hit.tolist()
        return n

    def ids(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))

    def shrink(self) -> None:
        if len(self) > self.limit:
            self.clear()
            self.hashes, self.kinds, self.prefixes = [], [], {}


def _counts(frames: Iterator[pd.DataFrame], bitmap) -> Iterator[pd.DataFrame]:
    """How often the runs asked for go on, end a text without a stop, and end with a stop; (field, text, cut) frames."""
    bits = bitmap.value
    known = _Tokens(bits)
    held: list[tuple[np.ndarray, int]] = []

    def add(keys: np.ndarray, kind: int) -> None:
        keys = keys[has(bits, keys)]
        if len(keys):
            held.append((keys, kind))

    def flush() -> pd.DataFrame:
        keys = np.concatenate([k for k, _ in held])
        kinds = np.concatenate([np.full(len(k), kind, np.int8) for k, kind in held])
        held.clear()
        out = pd.DataFrame({"key": keys.view(np.int64), **{n: (kinds == i).astype(np.int64) for i, n in enumerate(("n_mid", "n_open", "n_end"))}})
        return out.groupby("key", as_index=False).sum()

    for f in frames:
        known.shrink()
        for field, part in f.groupby("field", sort=False):
            tokens: list[str] = []
            code: list[str] = []
            clauses: Counter = Counter()
            for text, was_cut in zip(part["text"], part["cut"]):
                t = _GONE.sub("", text)
                sql = _SQL_START.search(t)
                if sql:
                    own = [x.lower() for x in _SQL_TOKEN.findall(t)]
                    code += [x for x in own[:-1] if x[:1].isalpha()]
                    clauses.update(("m", x) for x in own[:-1] if x in ("from", "where", "group", "order", "on"))
                    whole = t[sql.start() :].rstrip("`\n ")
                    if whole.endswith(";") or t.endswith("```"):
                        _, clause = _sql(whole.rstrip(";"))
                        if clause:
                            clauses["e", clause] += 1
                elif was_cut is True:
                    # What stands before a cut is no ending; a stop may be one.
                    own = _TOKEN.findall(t if t[-1:] in ".!?" and t[-2:-1].isalnum() else _MARK.sub("", t).rstrip(".…\ufffd"))
                    tokens += own if own and own[-1][0] in ".!?" else own[:-1]
                    tokens.append("\r")
                else:
                    tokens += _TOKEN.findall(t)
                    # Short values end without a stop; elsewhere an open ending says nothing.
                    tokens.append("\n" if field == "sample_values" else "\r")
            for (kind, clause), n in clauses.items():
                add(np.full(n, _key("sql:" + clause), np.int64).view(np.uint64), 0 if kind == "m" else 2)
            if code:
                ids = known.ids(code)
                add(shingle_hashes(np.array(known.hashes, np.uint64)[ids], 1), 0)
            if not tokens:
                continue
            ids = known.ids(tokens)
            h, kind = np.array(known.hashes, np.uint64)[ids], np.array(known.kinds, np.int8)[ids]
            at = np.arange(len(ids))
            begin = np.zeros(len(ids), np.int64)
            begin[1:] = np.maximum.accumulate(np.where((kind == 1) | (kind == 2) | (kind == 4), at + 1, 0))[:-1]
            run = at - begin
            for n in (1, 2, 3):
                grams = shingle_hashes(h, n)
                for sort, name in ((0, 0), (2, 1), (1, 2)):
                    own = grams[at[(kind == sort) & (run >= n)] - n]
                    add(own, name)
                    if field == "sample_values":
                        add((own.view(np.int64) ^ _SALT).view(np.uint64), name)
            if known.prefixes:
                number, n = np.unique(ids, return_counts=True)
                for i, k in zip(number, n):
                    for p in known.prefixes.get(int(i), ()):
                        add(np.full(k, p, np.uint64), 0)
        if sum(len(k) for k, _ in held) > 1_000_000:
            yield flush()
    if held:
        yield flush()


def encoded_lengths(c: Column) -> dict[str, Column]:
    """Length of a text under each encoding."""
    n = F.length(c)
    many = lambda chars: n - F.length(F.translate(c, chars, ""))
    crlf = many("\n") - (n - F.length(F.replace(c, F.lit("\r\n"), F.lit("\n"))))
    return {
        "characters": n,
        "utf8": F.octet_length(c),
        "utf16": F.when(F.octet_length(c) == n, n).otherwise(n + (n - F.length(F.regexp_replace(c, "[\\x{10000}-\\x{10FFFF}]", "")))),
        "entities": n + 4 * many("&") + 3 * many("<>") + 5 * many("\"'"),
        "json": n + many("\"\\\n\r\t\b\f"),
        "newlines": n + crlf,
    }


def unfolded(responses: DataFrame, profiles: DataFrame | None) -> DataFrame:
    """Both fields as (field, source, record_key, item_pos, text); null texts and keys are left out."""
    content = responses.select(F.lit("content").alias("field"), F.col("model").alias("source"), F.col("ingest_seq").cast("string").alias("record_key"), F.lit(0).alias("item_pos"), F.col("content").alias("text"))
    if profiles is None:
        return content.where("text is not null and record_key is not null")
    samples = profiles.select(F.lit("sample_values").alias("field"), F.col("db_id").alias("source"), F.col("column_no").cast("string").alias("record_key"), F.posexplode("sample_values").alias("item_pos", "text"))
    return content.unionByName(samples).where("text is not null and record_key is not null")


ENCODINGS = ("characters", "utf8", "utf16", "entities", "json", "newlines")
#: Bytes or units by which a limit steps back to a whole character.
STEP_BACK = {"utf8": 3, "utf16": 1}


def hidden_limits(texts: DataFrame) -> DataFrame:
    """(field, source, encoding, limit, reach, n_at_limit): the limits of each source that has any.

    `texts`: (field, source, lens array<int> by `ENCODINGS`, open boolean), each text once a source. Only texts of
    several words that don't end with a stop make a pile. A pile is at the longest length, or, where an older limit
    was lifted, inside, if it is larger (`INSIDE`, `INSIDE_STEEP`; not for limits in bytes or units of UTF-16). Limits in bytes may step back to a whole
    character, by at most `reach`, in texts with characters of several. A source whose longest texts stand at a limit of `SHARED` others has it too, however few they are.
    Of several encodings the one with the largest piles wins (a tenth larger than characters), ties by name.
    """
    lengths = F.explode(F.map_from_arrays(F.array(*map(F.lit, ENCODINGS)), F.col("lens"))).alias("encoding", "len")
    wide = F.col("open") & (F.col("len") > F.col("lens")[0])
    # Many texts have the same lengths under all encodings.
    alike = texts.groupBy("field", "source", "open", "lens").agg(F.count("*").alias("k"))
    times = lambda c: F.sum(F.when(c, F.col("k")).otherwise(0))
    histogram = alike.select("field", "source", "open", "lens", "k", lengths).groupBy("field", "source", "encoding", "len").agg(F.sum("k").alias("n"), times(F.col("open")).alias("n_open"), times(wide).alias("n_wide"))
    per = W.partitionBy("field", "source", "encoding")
    near = lambda a, b, c: F.coalesce(F.sum(c).over(per.orderBy("len").rangeBetween(a, b)), F.lit(0))
    back = F.coalesce(*[F.when(F.col("encoding") == e, F.lit(d)) for e, d in STEP_BACK.items()], F.lit(0))
    # Bytes: the lengths just below a limit may belong to it.
    before = F.when(F.col("back") == 0, near(-BEFORE, -1, "n")).when(F.col("back") == 1, near(-BEFORE - 1, -2, "n")).otherwise(near(-BEFORE - 3, -4, "n")) / BEFORE
    piles = histogram.withColumn("back", back).withColumns({"most": F.max("len").over(per), "before": before, "most_before": F.max("n").over(per.orderBy("len").rangeBetween(-BEFORE, -1)), "most_after": F.max("n").over(per.orderBy("len").rangeBetween(1, BEFORE)), **{f"d{d}": near(-d, -d, "n_wide") for d in (1, 2, 3)}})
    steps = [F.when((F.col("back") >= d) & (F.col(f"d{d}") >= 2) & (F.col(f"d{d}") >= STEEP * F.col("before")), F.lit(d)).otherwise(0) for d in (1, 2, 3)]
    piles = piles.withColumn("reach", F.greatest(*steps)).withColumn("pile", F.col("n_open") + sum(F.when(F.col("reach") >= d, F.col(f"d{d}")).otherwise(0) for d in (1, 2, 3)))
    top = F.col("len") == F.col("most")
    # Lengths on both sides, none near as frequent: names of like lengths make a pile too.
    inside = (F.col("back") == 0) & (F.col("pile") >= INSIDE) & (F.col("pile") >= INSIDE_STEEP * F.col("most_before")) & (F.col("pile") >= INSIDE_STEEP * F.col("most_after"))
    piles = piles.where((F.col("n_open") > 0) & (top | inside)).withColumn("own", F.when(top, (F.col("pile") >= PILE) & (F.col("pile") >= STEEP * F.col("before"))).otherwise(True)).withColumn("top", top)
    # One row a source and length: at most as many as there are sources.
    sources = F.count_if(F.col("own") & F.col("top")).over(W.partitionBy("field", "encoding", "len"))
    found = piles.withColumn("sources", sources).where(F.col("own") | F.col("top") & (F.col("sources") >= SHARED))
    # Plain characters explain a pile unless another encoding gathers clearly more.
    weight = F.sum("pile").over(per) * F.when(F.col("encoding") == "characters", 1.0).otherwise(0.9)
    best = W.partitionBy("field", "source").orderBy(F.desc("weight"), "encoding")
    return found.withColumn("weight", weight).withColumn("rn", F.dense_rank().over(best)).where("rn = 1").select("field", "source", "encoding", F.col("len").alias("limit"), "reach", F.col("pile").alias("n_at_limit"))


def judged(responses: DataFrame, profiles: DataFrame | None, only: str | None = None) -> DataFrame:
    """(field, source, record_key, item_pos, cut boolean): the verdict on every text; see `truncated`.

    `only`: the verdicts of one field, told by the texts of both.
    """
    spark = responses.sparkSession
    # Texts are known by two hashes; they themselves are shuffled once, each distinct one.
    rows = unfolded(responses, profiles).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    key = ["field", "k1", "k2"]
    mine = F.lit(True) if only is None else F.col("field") == only
    placed = cut(rows.where(mine).select(*key, "source", "record_key", "item_pos").distinct())
    once = rows.groupBy(*key).agg(F.min("source").alias("s0"), F.first("text").alias("text")).withColumn("lens", F.array(*[encoded_lengths(F.col("text"))[e] for e in ENCODINGS]))
    shape = "field string, k1 long, k2 long, s0 string, text string, lens array<int>"
    texts = cut(once.mapInPandas(_features, shape + ", cut boolean, grams array<long>, clause long, word long, open boolean"))
    # A whole ending at a limit (stop, closed bracket, nothing after it) is a text that just fits.
    stops = F.col("text").rlike("[.!?。！？:;}\\]`)\"]\\z").alias("stops")
    spread = cut(placed.select(*key, "source").distinct().join(texts.where(mine).select(*key, "lens", "cut", "grams", "clause", "word", "open", stops), key))
    found = hidden_limits(spread.select("field", "source", "lens", "open"))
    limits = cut(found.groupBy(F.col("field").alias("f"), F.col("source").alias("s")).agg(F.collect_list(F.struct("encoding", "limit", "reach")).alias("limits")))
    length = lambda name: F.element_at("lens", F.array_position(F.array(*map(F.lit, ENCODINGS)), name).cast("int"))
    stepped = lambda x: length(x.encoding).between(x.limit - x.reach, x.limit) & (length(x.encoding) > F.col("lens")[0])
    full = F.coalesce(F.exists("limits", lambda x: (length(x.encoding) == x.limit) | stepped(x)), F.lit(False))
    # A limit per source: joined by broadcast only where Spark finds the table small enough.
    at_limit = spread.join(limits, (F.col("field") == F.col("f")) & F.col("source").eqNullSafe(F.col("s")), "left").withColumn("full", full).drop("f", "s", "limits", "lens", "open")
    undecided = F.col("cut").isNull() & ((F.size("grams") > 0) | F.col("clause").isNotNull())
    verdict = F.when(F.col("full") & F.coalesce("cut", F.lit(True)), F.lit(True)).when(F.col("full") & F.col("stops"), F.lit(False)).when(F.col("full") & ~undecided, F.lit(True)).when(~F.col("full"), F.col("cut"))
    told_by = ["field", "grams", "clause", "word"]
    at_limit = cut(at_limit.withColumn("verdict", verdict).withColumn("undecided", F.col("verdict").isNull() & undecided))
    # Undecided endings, each once, and only the statistics that they ask for.
    asked = at_limit.where("undecided").select(*told_by).distinct()
    none = F.array().cast("array<struct<order:int,key:long>>")
    runs = lambda plus, salt: F.transform("grams", lambda g, i: F.struct((i + plus).cast("int").alias("order"), g.bitwiseXOR(F.lit(int(salt))).alias("key")))
    one = lambda column, order: F.when(F.col(column).isNotNull(), F.array(F.struct(F.lit(order).alias("order"), F.col(column).alias("key")))).otherwise(none)
    values_only = F.when(F.col("field") == "sample_values", runs(11, _SALT)).otherwise(none)
    wanted = cut(asked.select(*told_by, F.explode(F.concat(runs(1, 0), values_only, one("clause", 9), one("word", 20))).alias("g")).select(*told_by, "g.order", "g.key"))
    bitmap = spark.sparkContext.broadcast(filter_of(wanted, ["key"]))
    # Texts at a limit say nothing about endings.
    free = texts.join(limits, (F.col("field") == F.col("f")) & F.col("s0").eqNullSafe(F.col("s")), "left").where(~full)
    values = at_limit.where("field = 'sample_values' and not full").count()
    # Of the other field limits aren't known, so what ends its texts doesn't count either.
    counted = free.select("field", "text", F.when(mine, F.col("cut")).otherwise(True).alias("cut")).mapInPandas(lambda fs: _counts(fs, bitmap), "key long, n_mid long, n_open long, n_end long")
    stats = counted.groupBy("key").agg(F.sum("n_mid").alias("m"), F.sum("n_open").alias("o"), F.sum("n_end").alias("e"))
    known = wanted.join(stats, "key", "left")
    m, e = F.coalesce("m", F.lit(0)), F.coalesce("e", F.lit(0))
    # Of the open endings of short values the one in question is one.
    o = F.when(F.col("field") == "sample_values", F.greatest(F.coalesce("o", F.lit(0)) - 1, F.lit(0))).otherwise(0)
    # Longer runs lean on shorter ones, those among short values on those of the whole corpus.
    orders = (1, 2, 3, 11, 12, 13)
    by = known.groupBy(*told_by).agg(
        *[F.max(F.when(F.col("order") == n, m + e + o)).alias(f"t{n}") for n in orders],
        *[F.max(F.when(F.col("order") == n, e + o)).alias(f"e{n}") for n in orders],
        F.max(F.when(F.col("order") == 1, (m + e >= KNOWN) | (o >= KNOWN_ENDS) & (o >= KNOWN_SHARE * values))).alias("known"),
        F.max(F.when((F.col("order") == 9) & (m + e > 0), e / (m + e))).alias("s9"),
        F.max(F.when(F.col("order") == 20, m)).alias("longer"),
    )
    share = F.lit(0.2)
    for n in orders:
        share = (F.coalesce(f"e{n}", F.lit(0)) + LEAN * share) / (F.coalesce(f"t{n}", F.lit(0)) + LEAN)
    strange = ~F.coalesce("known", F.lit(False))
    told = (
        F.when(F.col("clause").isNotNull(), ((F.size("grams") > 0) & strange) | (F.coalesce("s9", F.lit(1.0)) < 0.02))
        # A value of one word is cut if it is no word of the corpus but begins one.
        .when(F.col("word").isNotNull(), strange & (F.coalesce("longer", F.lit(0)) >= KNOWN_ENDS))
        .otherwise(strange | (share < ENDING))
    )
    decided = by.select(*told_by, told.alias("told"), (F.col("clause").isNull() & F.col("word").isNull() & ~strange & (share >= FIRM)).alias("firm"))
    decided = decided.withColumnsRenamed({c: "a_" + c for c in told_by})
    same = [F.col(c).eqNullSafe(F.col("a_" + c)) for c in told_by]
    out = at_limit.join(decided, same[0] & same[1] & same[2] & same[3] & F.col("undecided"), "left")
    # At a limit only an ending that is nearly always one is whole.
    last = F.when(F.col("verdict").isNotNull(), F.col("verdict")).when(F.col("full"), ~F.coalesce("firm", F.lit(False))).otherwise(F.coalesce("told", F.lit(False)))
    t = out.select(F.col("field").alias("f"), F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("source").alias("s"), last.alias("cut"))
    by_text = (F.col("k1") == F.col("a1")) & (F.col("k2") == F.col("a2")) & F.col("source").eqNullSafe(F.col("s"))
    if only is None:
        # With one field all rows have it; a join by a constant makes Spark build five Bloom filters of 1 MB that drop no row and go into the closures of its stages.
        by_text = by_text & (F.col("field") == F.col("f"))
    return placed.join(t, by_text).select("field", "source", "record_key", "item_pos", "cut")


def truncated(responses: DataFrame, profiles: DataFrame) -> DataFrame:
    """(field, record_key, item_pos) of the texts that were cut before their end.

    Fields: `content` of responses, by `ingest_seq`, and the elements of `sample_values`, by `column_no`.
    Null and blank texts are not cut; fully equal rows give one result row; empty tables give none.
    """
    return judged(responses, profiles).where("cut").select("field", "record_key", "item_pos").distinct()


def truncation_rates(responses: DataFrame, profiles: DataFrame) -> DataFrame:
    """(field, source, n_texts, n_cut, rate): per model and per database; a null source is a source."""
    return judged(responses, profiles).groupBy("field", "source").agg(F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut")).withColumn("rate", F.col("n_cut") / F.col("n_texts"))
