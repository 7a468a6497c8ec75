"""Unusable answers: empty, refused, copied from the prompt, in another language, cut off.

Prompt and response are aligned by words: a response is a copy if shingles of three words that stand in the
prompt cover nearly all of its words, or if nearly all of its words are a subsequence of the prompt. Refusals are aligned with
templates by longest common subsequence, in every sentence of a response, however long; what declines in one
sentence and yet gives SQL, values or a column is an answer.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kolonnade.functions.keys import ident
from kolonnade.llm import languages, truncation
from kolonnade.llm.words import INVISIBLE, WORD, plain, words
from kolonnade.session import cut

#: Contents that only hold a place, in lower case without quotes and blanks.
PLACEHOLDERS = {"", "-", "--", "---", "—", "–", ".", "..", "...", "…", "?", "_", "n/a", "na", "nan", "null", "none", "nil", "undefined", "{}", "[]", "()", "<>", "tbd", "todo", "empty", "<empty>", "(empty)", "[empty]", "placeholder", "<placeholder>", "no answer", "no response", "<no response>", "[no response]"}

#: Ways to decline, one a line.
REFUSALS = """
I can't help with this request
I cannot assist with questions about this data
I am unable to help with that
I am not able to answer that
I can't answer this question
I cannot provide an answer to this
I cannot comply with this request
I must decline to produce this query
I won't be able to provide an answer here
I would rather not respond to that
I have to refuse this one
I refuse to answer this
answering this would go against my guidelines
that goes beyond what I am permitted to do
this is not something I can do
you will have to ask somebody else about this
no answer can be given to a question of this kind
diese Anfrage muss ich ablehnen
dabei kann ich nicht helfen
hier muss ich passen
dazu kann ich keine Auskunft geben
ich darf diese Frage nicht beantworten
das geht über meine Befugnisse hinaus
ich kann diese Frage nicht beantworten
ich kann Ihnen dabei leider nicht helfen
darauf kann ich keine Antwort geben
das müssen Sie jemand anderen fragen
je ne peux pas vous aider sur ce point
je ne suis pas en mesure de fournir cette réponse
il m'est impossible de répondre à cette demande
je dois refuser cette requête
cela dépasse ce qui m'est permis
il faudra poser la question à quelqu'un d'autre
je ne peux pas répondre à cette question
no puedo ayudar con esta petición
no me es posible responder a eso
no estoy en condiciones de dar una respuesta
debo rechazar esta consulta
eso supera lo que se me permite
tendrá que preguntar a otra persona
no puedo responder a esta pregunta
non posso aiutarla con questa richiesta
non sono in grado di rispondere a questa domanda
não posso ajudar com este pedido
não me é possível responder a isso
ik kan u hier niet bij helpen
ik moet dit verzoek weigeren
я не могу ответить на этот вопрос
я не могу помочь с этим запросом
"""

#: Words that lead into a repeated prompt.
LEADS = re.compile(r"\A\W*(?:sure|of course|certainly|okay|ok|gerne|natürlich|klar|bien sûr|certainement|d'accord|claro|por supuesto|desde luego|certo|zeker)?\W*(?:here (?:is|are|you go)[^:\n]{0,40}:|hier (?:ist |kommt )?[^:\n]{0,40}:|voici[^:\n]{0,40}:|aquí (?:está|tiene)[^:\n]{0,40}:|esta es[^:\n]{0,40}:|ecco[^:\n]{0,40}:|the (?:question|prompt) (?:was|is|reads):|you asked:)?", re.I)

#: Stems of language names in the languages of prompts, and words that ask for an answer.
NAMES = {
    "en": r"english|englisch\w*|anglais|inglés|inglese|inglês|engels",
    "de": r"german|deutsch\w*|allemand|alemán|tedesco|alemão|duits",
    "fr": r"french|französisch\w*|français|francés|francese|francês|frans",
    "es": r"spanish|spanisch\w*|espagnol|español|spagnolo|espanhol|spaans",
    "it": r"italian|italienisch\w*|italien|italiano",
    "pt": r"portuguese|portugiesisch\w*|portugais|portugués|portoghese|português",
    "nl": r"dutch|niederländisch\w*|holländisch\w*|néerlandais|neerlandés|holandés|olandese",
    "ru": r"russian|russisch\w*|russe|ruso|russo",
}
_ASKS = re.compile(r"\b(?:answer|reply|respond|write|response|antwort\w*|schreib\w*|répon\w*|rédig\w*|écri\w*|contest\w*|respond\w*|respuesta|escrib\w*|rispon\w*|antwoord\w*)\b", re.I)
_NAMED = {x: re.compile(rf"\b(?:in|auf|en|em|op|на)\s+(?:{n})\b", re.I) for x, n in NAMES.items()}
#: What a text that names a language holds in any case, folded.
_STEMS = sorted({x.split("\\")[0].casefold() for n in NAMES.values() for x in n.split("|")})
_STEMS = [x for x in _STEMS if not any(y != x and y in x for y in _STEMS)]
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")
_FENCED = re.compile(r"\A```\w*\s*(.*?)\s*(?:```)?\Z", re.S)

#: Statements; words that name a column as the answer, before and behind it.
_STATEMENT = re.compile(r"\bSELECT\b.+?\bFROM\b\s*\S+|\bINSERT\s+INTO\s+\S+|\bDELETE\s+FROM\s+\S+|\bUPDATE\s+\S+\s+SET\b|(?i:^\W*select\s[^.?!]+?\sfrom\s+\S+)", re.S | re.M)
_BLOCK = re.compile(r"```\w*\s*(.*?)\s*(?:```|\Z)", re.S)
_NAME = r"[`\"'«]?(?P<{}>\w+(?:[_.]\w+)+|(?-i:\w*[a-z][A-Z]\w*))"
_CHOICE = re.compile(
    rf"\A\W*(?:(?:but|so|still|however|aber|also|mais|donc|pero|así que)\W+)?(?:use|choose|pick|take|nimm|verwende|nutze|utilise[rz]?|choisissez|usa|use|elige)\s+{_NAME.format('a')}"
    rf"|{_NAME.format('b')}\W+(?:is the (?:one|best|right|safer|answer)|fits|holds|contains|stores|passt|enthält|speichert|ist die (?:beste|richtige)|convient|contient|est (?:le|la) (?:meilleur|bon)|contiene|corresponde|es (?:la|el) (?:mejor|correct))",
    re.I,
)
#: Keys and words of JSON that say how a request went and answer nothing.
STATES = {"status", "state", "error", "type", "role", "code", "model", "id", "request_id", "stage"}
NO_VALUES = {"refused", "refusal", "declined", "denied", "rejected", "error", "failed", "unknown", "false", "true", "no"}

COPIED, SHINGLE, LEAST_COPY = 0.9, 3, 5
#: Share of a template's words that a refusal has in order, and words that may stand between them.
REFUSED, BETWEEN = 0.8, 14
#: Words of prose that tell a language, and words of a full sentence that do where there is less.
LEAST_PROSE, LEAST_SAID = 5, 3


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over `a`."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for w in b:
        hit = row & at.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _bare(content: str) -> str:
    t = (content if content.isascii() else INVISIBLE.sub("", content)).strip()
    m = _FENCED.match(t) if t.startswith("```") else None
    return m.group(1).strip() if m else t


def is_empty(content: str | None) -> bool:
    if content is None:
        return True
    t = _bare(content)
    return t.strip("\"'` \t\n").lower() in PLACEHOLDERS or t.lower() in PLACEHOLDERS


class Judge:
    """First defect of a response besides being cut off."""

    def __init__(self, model: languages.Model | None):
        self.model = model
        self.reader = model.reader() if model else None
        self.templates = [words(line) for line in REFUSALS.strip().splitlines()]
        self.vocabulary = [set(t) for t in self.templates]
        self.users: dict[str, list[int]] = {}
        for k, v in enumerate(self.vocabulary):
            for w in v:
                self.users.setdefault(w, []).append(k)
        # Counts of all templates in one number, a byte each; what is missing to 128 of the least count is added.
        self.lanes = {w: sum(1 << 8 * k for k in ks) for w, ks in self.users.items()}
        least = [next(n for n in range(len(t) + 1) if self.enough(k, n)) for k, t in enumerate(self.templates)]
        self.fewest, self.missing, self.tops = min(least), sum((128 - n) << 8 * k for k, n in enumerate(least)), sum(128 << 8 * k for k in range(len(least)))

    def enough(self, k: int, n: int) -> bool:
        """Whether `n` different words of a template are as many as a sentence needs."""
        t = self.templates[k]
        return n + len(t) - len(self.vocabulary[k]) >= (len(t) if len(t) < 5 else REFUSED * len(t))

    def declines(self, ws: list[str]) -> bool:
        """Whether a template stands in the words of a sentence, with at most `BETWEEN` words more than its own."""
        shared: dict[int, int] = {}
        for w in set(ws):
            for k in self.users.get(w, ()):
                shared[k] = shared.get(k, 0) + 1
        for k, n in shared.items():
            t, v = self.templates[k], self.vocabulary[k]
            need, most = len(t) if len(t) < 5 else REFUSED * len(t), len(t) + BETWEEN
            if n + len(t) - len(v) < need:
                continue
            begins = [i for i, w in enumerate(ws) if w in v] if len(ws) > most else [0]
            if any(common_subsequence(t, ws[i : i + most]) >= need for i in begins):
                return True
        return False

    def may_decline(self, ws: list[str]) -> bool:
        """Whether the words of a whole content hold as many of a template as a sentence needs."""
        hits = self.lanes.keys() & ws
        return len(hits) >= self.fewest and bool((sum(map(self.lanes.__getitem__, hits)) + self.missing) & self.tops)

    def refuses(self, content: str, prompt: str = "") -> bool:
        """Whether a sentence that isn't the prompt's declines, and nothing else in the content answers."""
        sentences = [(s, words(s)) for s in _SENTENCE.split(content) if s.strip()]
        said = [ws for _, ws in sentences if self.declines(ws)]
        if not said:
            return False
        asked = {tuple(words(s)) for s in _SENTENCE.split(prompt)}
        return any(tuple(ws) not in asked for ws in said) and not self.answers(content, [s for s, ws in sentences if ws not in said], prompt)

    def answers(self, content: str, rest: list[str], prompt: str) -> bool:
        """Whether a content that declines holds SQL or values besides, or names a column of the prompt as the answer."""
        given = " ".join(prompt.split())
        if any(" ".join(m.group().split()) not in given for m in _STATEMENT.finditer(content)):
            return True
        for block in (_bare(content), *_BLOCK.findall(content), content[content.find("{") : content.rfind("}") + 1]):
            if block[:1] in "{[" and block:
                try:
                    found = json.loads(block, strict=False)
                except ValueError:
                    continue
                if self.valued(found):
                    return True
        for m in filter(None, map(_CHOICE.search, rest)):
            if (m["a"] or m["b"]).rstrip(".").lower() in given.lower():
                return True
        return False

    def valued(self, x) -> bool:
        """Whether JSON holds a value: a name or word, not a number, a sentence, a placeholder or a state."""
        if isinstance(x, dict):
            return any(self.valued(v) for k, v in x.items() if k.lower() not in STATES)
        if isinstance(x, list):
            return any(map(self.valued, x))
        if not isinstance(x, str) or is_empty(x) or x.strip().lower() in NO_VALUES:
            return False
        return len(x.split()) <= 4 and x.strip()[-1] not in ".!?" and not self.declines(words(x))

    def copies(self, content: str, prompt: str, ws: list[str] | None = None) -> bool:
        """Whether a content gives back the prompt or a part of it. Under `LEAST_COPY` words it must be all of it, or its question: a bare name is an answer. `ws`: the words of the content."""
        said = LEADS.sub("", content, count=1)
        own = ws if ws is not None and len(said) == len(content) else words(said)
        short, text = len(said.split()) < LEAST_COPY, plain(prompt)
        if not short:
            # A word of the prompt stands in its text; most contents have too many others among their first words.
            left = len(own)
            for w in own:
                if w not in text:
                    left -= 1
                    if left < COPIED * len(own):
                        return False
        given = WORD.findall(text)
        if short:
            return len(own) > 1 and (own == given or said.rstrip().endswith("?") and any(own == words(q) for q in _SENTENCE.split(prompt) if q.rstrip().endswith("?")))
        # Both tests ask for most words to stand in the prompt somewhere.
        held = set(given)
        if sum(w in held for w in own) < COPIED * len(own):
            return False
        n = min(SHINGLE, len(own))
        shingles = {tuple(given[i : i + n]) for i in range(len(given) - n + 1)}
        covered = [False] * len(own)
        for i in range(len(own) - n + 1):
            if tuple(own[i : i + n]) in shingles:
                covered[i : i + n] = [True] * n
        inside = sum(covered) / len(own)
        return inside >= COPIED or inside >= 0.5 and common_subsequence(own, given) >= 0.95 * len(own)

    def languages(self, texts: list[str | None]) -> list[str | None]:
        """Language of most words of the prose of each text, if it has enough prose to tell; sentences of all are read at once."""
        batch: list[list[str]] = []
        owner: list[int] = []
        for i, text in enumerate(texts):
            read = [(ws, full) for _, _, full, prose in languages.sentences(text or "") if (ws := languages.natural_words(prose))]
            if sum(len(ws) for ws, _ in read) < LEAST_PROSE:
                read = [(ws, full) for ws, full in read if full and len(ws) >= LEAST_SAID]  # names and decisions are no prose
            batch += [ws for ws, _ in read]
            owner += [i] * len(read)
        out: list[str | None] = [None] * len(texts)
        if not batch or not self.reader:
            return out
        weight: dict[tuple[int, int], int] = {}
        for i, k, s, u, ws in zip(owner, *(x.tolist() for x in self.reader.read(batch)), batch):
            if languages.settled(len(ws), s, u):
                weight[i, k] = weight.get((i, k), 0) + len(ws)
        best: dict[int, tuple[int, int]] = {}
        for (i, k), n in weight.items():
            best[i] = max(best.get(i, (0, 0)), (n, -k))
        for i, (_, k) in best.items():
            out[i] = self.model.languages[-k]
        return out

    def asked(self, prompt: str) -> str | None:
        """The language a prompt asks for by name."""
        folded = prompt.casefold().replace("ı", "i")
        if any(x in folded for x in _STEMS) and _ASKS.search(prompt):
            for s in _SENTENCE.split(prompt):
                if _ASKS.search(s):
                    for x, name in _NAMED.items():
                        if name.search(s):
                            return x
        return None

    def prose(self, content: str) -> str | None:
        t = _bare(content)
        if t[:1] in "{[":
            try:
                found = json.loads(t, strict=False)
            except ValueError:
                return None
            said: list[str] = []

            def walk(x):
                if isinstance(x, str) and " " in x:
                    said.append(x if x[-1:] in ".!?" else x + ".")
                elif isinstance(x, dict):
                    for v in x.values():
                        walk(v)
                elif isinstance(x, list):
                    for v in x:
                        walk(v)

            walk(found)
            return " ".join(said)
        return t

    def first(self, content: str | None, prompt: str) -> str | None:
        """The first defect besides a wrong language."""
        if is_empty(content):
            return "empty"
        ws = words(content)
        if self.may_decline(ws) and self.refuses(content, prompt):
            return "refusal"
        return "copy" if self.copies(content, prompt, ws) else None

    def defects(self, contents: list[str | None], prompts: list[str]) -> list[str | None]:
        out = [self.first(c, p) for c, p in zip(contents, prompts)]
        rest = [i for i, d in enumerate(out) if d is None]
        own = self.languages([self.prose(contents[i]) for i in rest])
        told = [(i, x) for i, x in zip(rest, own) if x]
        wanted = {p: self.asked(p) for p in {prompts[i] for i, _ in told}}
        written = [p for p, x in wanted.items() if not x]
        wanted.update(zip(written, self.languages(written)))
        for i, x in told:
            if wanted[prompts[i]] and wanted[prompts[i]] != x:
                out[i] = "language"
        return out

    def defect(self, content: str | None, prompt: str) -> str | None:
        return self.defects([content], [prompt])[0]


def _judged(frames: Iterator[pd.DataFrame], model: languages.Model | None) -> Iterator[pd.DataFrame]:
    judge = Judge(model)
    for f in frames:
        # Redeliveries lie next to each other.
        both = list(zip(f["content"], f["prompt"]))
        once = list(dict.fromkeys(both))
        told = dict(zip(once, judge.defects([c for c, _ in once], [p for _, p in once])))
        yield pd.DataFrame({"ingest_seq": f["ingest_seq"], "h": f["h"], "defect": [told[x] for x in both]})


def defective(responses: DataFrame, requests: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """(ingest_seq, defect): responses to known requests with the first defect that applies.

    Defects in order: empty, refusal, copy, language, truncated. What is truncated is told over the same corpus
    as in `truncated`, if `profiles` are given. Request identifiers compare stripped and in lower case; null ones
    join nothing. Where a request has several prompts, a response is a copy if it copies any, a refusal if it
    declines whatever the prompt, and in a wrong language if it is for all; a null prompt joins nothing. Equal
    rows give one result row; further columns are ignored; empty tables give no rows.
    """
    prompts = requests.select(ident(F.col("request_id")).alias("id"), "prompt").where("id is not null and prompt is not null").distinct()
    content = F.xxhash64(F.coalesce("content", F.lit("\0")))
    delivered = responses.select(ident(F.col("request_id")).alias("id"), "ingest_seq", "content", content.alias("h")).where("ingest_seq is not null").dropDuplicates(["id", "ingest_seq", "h"])
    pairs = cut(delivered.join(prompts, "id").select("ingest_seq", "h", "content", "prompt"))
    model = languages.fit_unlabelled(pairs.select(F.explode(F.array("content", "prompt")).alias("text")))
    seen = pairs.mapInPandas(lambda fs: _judged(fs, model), "ingest_seq long, h long, defect string")
    by = seen.groupBy("ingest_seq", "h").agg(*[F.count_if(F.col("defect") == d).alias(d) for d in ("empty", "refusal", "copy", "language")], F.count("*").alias("n"))
    told = by.select("ingest_seq", F.when(F.col("empty") > 0, "empty").when(F.col("refusal") == F.col("n"), "refusal").when(F.col("copy") > 0, "copy").when(F.col("language") + F.col("refusal") == F.col("n"), "language").alias("defect"))
    ends = truncation.judged(responses, profiles, "content").where("cut").select(F.col("record_key").cast("long").alias("ingest_seq"), F.lit("truncated").alias("ended")).distinct()
    return told.join(ends, "ingest_seq", "left").select("ingest_seq", F.coalesce("defect", "ended").alias("defect")).where("defect is not null").distinct()
