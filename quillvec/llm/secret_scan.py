"""Secret scan by assignment-aware lexing.

Every ``=``, ``:``, ``:=`` and ``=>`` of a text is read as a possible assignment: a name (identifier, dotted or bracketed
path, or quoted key) before it, an expression after it: quoted literals, names, and their concatenations with ``+``; in
configuration syntax also a bare value. A bare word that is all there is on a key/value line, whatever the operator, or that
follows a tight ``=`` and has a digit, is a literal like a quoted one, unless it reads as a name: it was assigned to above,
it is a path or a sensitive name without digits (``user_password``), or it has no digit but at its end and the text uses it
elsewhere than as such a value. The word for an authorization scheme is no part of the literal. Constants are propagated in
textual order: a literal carries every name it flows to, directly, through other names, or as a part of a concatenation. A
literal is scored by the most sensitive of those names, times its strength (length, entropy and character classes);
placeholders, which have ``PLACEHOLDER_CHARS`` characters at most, have none. Literals that reach ``THRESHOLD`` are secrets; a
literal that begins inside a reported one isn't reported again.

The time is proportional to the length of the text: a run of characters without blanks is looked at once, however many
operators it has; values of names are nodes that point to the values they are made of, and sensitivity is passed down from
the last node to the first.

Defined cases: null and empty texts have no findings and are returned as they are. Repeated rows give repeated
findings; a null doc_id stays null, and it may be of any type. Texts are lexed whole, whatever their length; names are read
back to their first character. ``redact`` replaces each secret with ``MARK`` and sets n_chars, where it is a column and the
text changed; other columns and rows are unchanged whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.llm.columns import kind, plain, restored

THRESHOLD, MARK, PLACEHOLDER_CHARS = 0.5, "[SECRET]", 256
OPERATOR = re.compile(r":=|=>|(?<![=!<>+\-*/%&|^~:])=(?![=~])|(?<![:\w]):(?![:=/])|(?<=\w):(?![:=/])")
STRING = re.compile(r"""[fFrRbBuU]{0,2}(?:\"\"\"(?P<t>.*?)\"\"\"|'''(?P<u>.*?)'''|"(?P<d>(?:[^"\\\n]|\\.)*)"|'(?P<s>(?:[^'\\\n]|\\.)*)'|`(?P<b>[^`\n]*)`)""", re.S)
NAME = re.compile(r"[A-Za-z_$][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*|\[[\"'][\w.\-]+[\"']\])*")
BARE = re.compile(r"[^\s\"'`,;#<>(){}\[\]|]+")
SCHEME = re.compile(r"(?i)(?:bearer|basic|digest|token|negotiate|api-?key)[ \t]+(?=\S)")
WORD, PATH = re.compile(r"[A-Za-z_$][\w$]*"), re.compile(r"\.|->|::|\[")
BLANK = re.compile(r"[ \t]*(?:\\\n[ \t]*)?")
GAP, DIGIT = re.compile(r"\s*"), re.compile(r"\d")
STRING_STARTS, SCHEME_STARTS = frozenset("fFrRbBuU\"'`"), frozenset("bBdDtTnNaA")
PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "pass": 0.9, "secret": 1.0, "secrets": 1.0, "token": 0.9, "tokens": 0.9, "apikey": 0.9, "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "authorization": 0.8, "auth": 0.7, "jwt": 0.8, "signature": 0.6, "salt": 0.6}
KEY_KINDS = {"api", "access", "private", "secret", "encryption", "signing", "account", "master", "auth", "ssh", "client", "service", "app"}
HARMLESS = {"count", "counts", "length", "len", "size", "max", "min", "limit", "type", "name", "url", "uri", "path", "file", "field", "label", "policy", "id", "hint", "placeholder", "regex", "pattern", "expiry", "ttl", "public"}
PLACEHOLDER = re.compile(r"(?i)^(?:x{3,}|\*{3,}|\.{3,}|-+|_+|0+|(?:1234567890)*1234(?:5(?:6(?:7(?:8(?:90?)?)?)?)?)?|change_?me\S*|replace_?me\S*|your[_\- ].*|my[_\- ]?(?:password|secret|token|key).*|<.*>|\$\{.*\}|\$\(.*\)|\$\w+|\{\{.*\}\}|%\w+%|null|none|nil|undefined|true|false|example\S*|sample\S*|dummy\S*|test|todo|tbd|n/?a|redacted|\[secret\]|password|secret|token|string|str|int|optional|required)$")


@functools.lru_cache(1 << 14)
def name_weight(name: str) -> float:
    """How sensitive a target name is, from 0 to 1."""
    parts = [p.lower() for p in PIECE.findall(name)]
    if not parts or parts[-1] in HARMLESS:
        return 0.0
    weight = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    for a, b in zip(parts, parts[1:]):
        if b in ("key", "keys") and a in KEY_KINDS:
            weight = max(weight, 0.9)
    return max(weight, 0.45 if parts[-1] == "key" else 0.0)


def strength(literal: str) -> float:
    """How much a literal looks like a secret value, from 0 to 1."""
    n = len(literal)
    if n < 4 or n <= PLACEHOLDER_CHARS and PLACEHOLDER.match(literal):
        return 0.0
    counts = Counter(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = sum(bool(re.search(p, literal)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^\w\s]"))
    if " " in literal:
        return 0.55 if kinds >= 3 and n <= 64 else 0.1
    if n >= 16 and entropy >= 3.0 and re.search(r"\d", literal):
        return 1.0
    if n >= 20 and entropy >= 3.5:
        return 0.8
    return min(0.85, 0.2 * kinds + 0.02 * n + 0.08 * entropy)


def _before(text: str, i: int) -> str | None:
    """The name that ends before position i."""
    j = i
    while j and text[j - 1] in " \t":
        j -= 1
    if j and text[j - 1] in "\"'`":
        quote, k = text[j - 1], j - 1
        while k and text[k - 1] != quote and text[k - 1] != "\n" and (text[k - 1].isalnum() or text[k - 1] in "_-. $"):
            k -= 1
        return text[k : j - 1] or None if k and text[k - 1] == quote else None
    if j and text[j - 1] == "]":
        k = j - 1
        while k and (text[k - 1].isalnum() or text[k - 1] in "_-.\"'"):
            k -= 1
        inner = text[k : j - 1].strip("\"'")
        return inner if k and text[k - 1] == "[" and re.fullmatch(r"[\w.\-]+", inner) else None
    k = j
    while k and (text[k - 1].isalnum() or text[k - 1] in "_-.$"):
        k -= 1
    name = text[k:j].strip("-.")
    return name if name and not name[0].isdigit() else None


KEY_LINE = re.compile(r"\s*(?:export|set|-|\+)?\s*[\"']?[\w.\-$\[\]\"']+\s*(?:=|:|:=|=>)\s*")


class Lexer:
    """A text and what has been learnt of it; operators are taken in order of place."""

    def __init__(self, text: str):
        self.text = text
        self.run = (0, 0, 0)
        self.last = 0  # the end of the operator before this one

    def bare(self, i: int) -> tuple[int, int]:
        """(end, end without closing marks) of the run of bare characters from i; both i if there is none."""
        start, end, stop = self.run
        if not start <= i < end:
            m = BARE.match(self.text, i)
            if not m:
                return i, i
            start, end = m.span()
            stop = end
            while stop > start and self.text[stop - 1] in ".!?:":
                stop -= 1
            self.run = start, end, stop
        return end, max(i, stop)

    def operator(self, m: re.Match) -> None:
        """Take the next operator; on a line, only the first one can have nothing but a key before it."""
        at = self.text.rfind("\n", self.last, m.start())
        self.key = KEY_LINE.fullmatch(self.text, at + 1, m.end()) is not None if at >= 0 or not self.last else False
        self.last = m.end()

    def alone(self, i: int) -> bool:
        """Whether a key and the operator are all there is on the line before position i."""
        return self.key and "\n" not in self.text[self.last : i]

    def sole(self, i: int) -> bool:
        """Whether nothing but blanks or a comment follows on the line."""
        j = i
        while self.text[j : j + 1] in (" ", "\t"):
            j += 1
        return j == len(self.text) or self.text[j] == "\n" or self.text.startswith("\r\n", j) or j > i and self.text[j] == "#"

    def after_scheme(self, i: int) -> tuple[int, int] | None:
        """The credential after the word for an authorization scheme at i, if it ends its line or its quoted string."""
        m = SCHEME.match(self.text, i) if self.text[i : i + 1] in SCHEME_STARTS else None
        end = self.bare(m.end())[0] if m else i
        if m and end > m.end() and (self.text[end : end + 1] in ("'", '"', "`") or self.sole(end)):
            return m.end(), end
        return None


def _expression(lexer: Lexer, i: int, op: str) -> list[tuple]:
    """Terms ("lit" or "bare", start, end), ("ref", name), ("name", start, end) or ("word", start, end) of the expression at i.

    A "name" is an identifier alone, a "word" one that stands where a configuration value does.
    """
    text, terms = lexer.text, []
    while True:
        i = BLANK.match(text, i).end()
        first = text[i : i + 1]
        m = STRING.match(text, i) if first in STRING_STARTS else None
        if m:
            whole = m.span(m.lastgroup)
            held = lexer.after_scheme(whole[0])
            terms.append(("lit", *(held if held and held[1] == whole[1] else whole)))
            i = m.end()
        else:
            held = None if terms else lexer.after_scheme(i)
            if held:
                return [("lit", *held)]
            m = NAME.match(text, i)
            end = m.end() if m else i
            if not terms and first not in ("", "=", "+"):
                run, stop = lexer.bare(i)
                joined = m and text[end : end + 1] == "+" and text[end + 1 : end + 2] in ('"', "'", "`", " ", "\t")
                if run > end and not joined:
                    return [("bare", i, stop)] if op in ("=", ":=") or lexer.alone(i) else []
            if not m:
                return terms
            if text[end : end + 1] == "(":
                return terms  # a call: its value isn't known
            if not terms:
                # an identifier alone: a name, or a bare configuration value
                tight = op == "=" and text[i - 1] == "=" and not text[i - 2].isspace() and DIGIT.search(text, i, end)
                sole = lexer.alone(i) and lexer.sole(end) or tight and text[end : end + 1] in ("", " ", "\t", "\r", "\n", "'", '"')
                terms.append(("word" if sole else "name", i, end))
            else:
                terms.append(("ref", text[i:end]))
            i = end
        j = BLANK.match(text, i).end()
        after = text[j : j + 1]
        if after == "+" and text[j + 1 : j + 2] not in ("+", "="):
            i = GAP.match(text, j + 1).end()
        elif terms[-1][0] == "lit" and after in STRING_STARTS and STRING.match(text, j):
            i = j
        else:
            return terms


def scan(text: str | None) -> list[tuple[int, int, str, float]]:
    """(start, end, most sensitive name, score) of each secret literal, in order of place."""
    if not text or ("=" not in text and ":" not in text):
        return []
    lexer = Lexer(text)
    names: list[str] = []
    made_of: list[tuple[list, list]] = []  # the literals and the earlier nodes that an assigned value is made of
    values: dict[str, int] = {}
    words: set[tuple[int, int]] = set()
    taken = 0
    weigh = lambda n: name_weight(n) if len(n) <= 128 else name_weight.__wrapped__(n)
    for m in OPERATOR.finditer(text):
        lexer.operator(m)
        if m.start() < taken:
            continue  # inside the bare value of a sensitive name
        name = _before(text, m.start())
        if name is None:
            continue
        literals, nodes = [], []
        for term in _expression(lexer, m.end(), m.group()):
            if term[0] == "lit":
                literals.append(term[1:])
            elif term[0] == "bare":
                literals.append(term[1:])
                weight = weigh(name)
                if weight >= THRESHOLD and weight * strength(text[term[1] : term[2]]) >= THRESHOLD:
                    taken = term[2]
            elif term[0] == "ref":
                if term[1] in values:
                    nodes.append(values[term[1]])
            else:
                word = text[term[1] : term[2]]
                if word in values:
                    nodes.append(values[word])
                elif m.group() in ("=", ":=") and strength(word) == 1.0:
                    literals.append(term[1:])
                elif term[0] == "word" and (any(c.isdigit() for c in word) or not name_weight(word) and not PATH.search(word)):
                    literals.append(term[1:])
                    words.add(term[1:])
        values[name] = len(names)
        names.append(name)
        made_of.append((literals, nodes))
    # a node's weight is that of its own name or of a later node made of it; of equal weights the first name counts
    best = [(weigh(n), -k) for k, n in enumerate(names)]
    flows: dict[tuple[int, int], tuple[float, int]] = {}
    for k in range(len(names) - 1, -1, -1):
        for p in made_of[k][0]:
            flows[p] = max(flows.get(p, best[k]), best[k])
        for j in made_of[k][1]:
            best[j] = max(best[j], best[k])
    out, end = [], 0
    used, as_value = None, Counter(text[a:b] for a, b in words)
    for (a, b), (weight, k) in sorted(flows.items()):
        if a < end or weight < THRESHOLD:
            continue
        score = weight * strength(text[a:b])
        if score >= THRESHOLD and (a, b) in words and re.fullmatch(r"[^\d]+\d{0,2}", text[a:b]):
            used = Counter(WORD.findall(text)) if used is None else used
            if used[text[a:b]] > as_value[text[a:b]]:
                continue
        if score >= THRESHOLD:
            out.append((a, b, names[-k], round(score, 6)))
            end = b
    return out


def redacted(text: str | None) -> str | None:
    found, at, out = scan(text), 0, []
    if not found:
        return text
    for a, b, _, _ in found:
        out += [text[at:a], MARK]
        at = b
    return "".join(out) + text[at:]


def _findings(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        rows = [(i, a, b, name, s, hashlib.sha256(t[a:b].encode()).hexdigest()[:16]) for i, t in enumerate(texts) for a, b, name, s in scan(t)]
        cols = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string()]
        at, *rest = (pa.array(list(c), k) for c, k in zip(cols, kinds))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), *rest], names=["doc_id", "start", "end", "name", "score", "literal_sha256"])


def _maybe() -> Column:
    """A text without an operator has no assignment; it needn't go to Python."""
    return F.col("text").contains("=") | F.col("text").contains(":")


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, name, score, literal_sha256): one row for each secret; places count characters."""
    some = plain(docs, ["doc_id", "text"]).select("doc_id", "text").where(_maybe())
    return some.mapInArrow(_findings, f"doc_id {kind(some, 'doc_id')}, start long, end long, name string, score double, literal_sha256 string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with their columns, secrets replaced."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(t):
            new = redacted(t) if isinstance(t, str) else None
            return None if new == t else new

        return texts.map(one)

    inner = plain(docs, ["text"], ["n_chars"])
    out = inner.withColumn("clean", clean(F.when(_maybe(), F.col("text"))))
    changes = {"text": F.coalesce("clean", "text")}
    if "n_chars" in inner.columns:
        changes["n_chars"] = F.when(F.col("clean").isNull(), F.col("n_chars")).otherwise(F.length("clean").cast(inner.schema["n_chars"].dataType))
    return restored(out.withColumns(changes), inner, docs)


def query(spark, sf_dir: str) -> DataFrame:
    return findings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
