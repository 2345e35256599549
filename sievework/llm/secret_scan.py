"""Secrets in texts: three fixed patterns, and strings that look random to character Markov models.

Two Markov chains over characters (two of context, add-one smoothed with back-off to one and none) are trained from
labelled samples: random strings, and ordinary identifiers. A run of token characters is a secret when the log-likelihood
ratio of the two chains, over the whole run, exceeds a threshold. Of a run that overlaps fixed patterns' spans, what lies
outside them is marked (UUIDs are passed over): all of it if the whole run is a secret, else each rest that is long enough and one by itself.

Spans are code points, end exclusive, of a pattern's whole match. Null and empty texts have no span; texts of any length
are searched whole; repeated rows get repeated results and empty tables empty ones. Other columns pass by unread.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import map_arrow, slices

KINDS = ("assign", "access", "hex", "random")
_WORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = re.compile(rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Length of the runs that the chains judge, and the mean log-likelihood ratio (natural) a character, above which a run is random.
LEAST, RATIO = 20, 1.0
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: What a text must match to be looked at more closely, in the syntax of Arrow's own engine.
_SIEVE = rf"(?:{_WORDS})[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{{12}}|[A-Z0-9]{{18}}|[0-9a-f]{{16}}|[A-Za-z0-9+/_=-]{{{LEAST}}}"
#: Universally unique identifiers are random but name things openly: a run of that shape is not judged.
UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"


class Markov:
    """Characters given the two before, interpolated with shorter contexts."""

    def __init__(self, strings: list[str]):
        n = len(_ALPHABET)
        counts: dict[str, dict[str, int]] = {}
        for s in strings:
            s = "^^" + s
            for i in range(2, len(s)):
                for context in (s[i - 2 : i], s[i - 1], ""):
                    counts.setdefault(context, {}).setdefault(s[i], 0)
                    counts[context][s[i]] += 1
        total = {c: sum(v.values()) for c, v in counts.items()}
        none = counts.get("", {})
        self.base = {ch: (none.get(ch, 0) + 1) / (total.get("", 0) + n) for ch in _ALPHABET}
        self.counts, self.total, self.memo = counts, total, {}

    def log_probability(self, text: str) -> float:
        text, out = "^^" + text, 0.0
        memo = self.memo
        for i in range(2, len(text)):
            key = text[i - 2 : i + 1]
            if key not in memo:
                p = self.base[key[2]]
                for context in (key[1], key[:2]):
                    t = self.total.get(context, 0)
                    p = (self.counts.get(context, {}).get(key[2], 0) + 8 * p) / (t + 8)
                memo[key] = math.log(p)
            out += memo[key]
        return out


class RandomStrings:
    """The two chains; samples are (string, 1 for random or 0 for ordinary)."""

    def __init__(self, samples: list[tuple[str, int]]):
        self.random = Markov([s for s, y in samples if y])
        self.ordinary = Markov([s for s, y in samples if not y])

    def ratio(self, text: str) -> float:
        return self.random.log_probability(text) - self.ordinary.log_probability(text)


_COMMON = (
    "get set add remove delete create update find load save read write open close start stop run init parse format build make check test is has to from with by for of and or not "
    "user name file path list map index count size value key type data item node tree row column field record page text line word token string number date time year month day "
    "hour minute second error message result request response client server session cookie header body content length offset limit order sort filter group query search match replace "
    "config option setting default version release license copyright public private static final class object function method module package import export return model view controller "
    "service manager factory handler listener event state action reducer store context provider component element button input output image video audio document window screen width "
    "height color font style border margin padding left right top bottom center first last next previous parent child root branch leaf source target origin destination address city "
    "country language english german french spanish italian account balance payment invoice product price quantity customer supplier discount shipping returned abstract interface "
    "software foundation general warranty condition permission provided distributed including without limitation information international development environment application "
    "administration responsibility communication understanding approximately nevertheless the in on at this that there here over under through between because before after again against "
    "und der die das nicht eine werden wissenschaft gesellschaft verantwortung entwicklung verbindung bundesrepublik krankenversicherung geschwindigkeit freundlichkeit zusammenarbeit "
    "les des une que pour dans avec nouvelle gouvernement developpement anticonstitutionnellement immediatement maintenant beaucoup travailleur bibliotheque "
    "los las del por para con desarrollo investigacion responsabilidad universidad gobierno trabajador inmediatamente conocimiento"
).split()


def builtin_samples(n: int = 4000) -> list[tuple[str, int]]:
    """Labelled samples, the same on every machine: digests recoded to the alphabets of keys (random); common words joined as
    names, paths and the like, and rules of punctuation (ordinary)."""
    out: list[tuple[str, int]] = []
    kinds = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
    for i in range(n):
        d = hashlib.sha512(f"random {i}".encode()).digest()
        alphabet = kinds[i % len(kinds)]
        out.append(("".join(alphabet[b % len(alphabet)] for b in d[: 20 + d[63] % 40]), 1))
        d = hashlib.sha512(f"ordinary {i}".encode()).digest()
        words = [_COMMON[(d[2 * k] * 256 + d[2 * k + 1]) % len(_COMMON)] for k in range(2 + d[60] % 5)]
        style = d[61] % 8
        if style == 0:
            word = "_".join(words)
        elif style == 1:
            word = "-".join(words)
        elif style == 2:
            word = "/".join(words)
        elif style == 3:
            word = words[0] + "".join(w.title() for w in words[1:])
        elif style == 4:
            word = "_".join(words).upper()
        elif style == 5:
            word = "-".join(words) + f"-{d[62]}/{2000 + d[59] % 30}"
        elif style == 6:
            word = "=" * (8 + d[59] % 24) if d[58] % 2 else "-" * (8 + d[59] % 24)
        else:
            word = "".join(words)
        out.append((word, 0))
    return out


def find(text: str, model: RandomStrings) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in order."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    # What the patterns cover, as intervals in order that don't overlap.
    begin, end = [], []
    for a, _, b in sorted(spans):
        if end and a <= end[-1]:
            end[-1] = max(end[-1], b)
        else:
            begin.append(a)
            end.append(b)
    for m in RUN.finditer(text):
        if UUID.fullmatch(m.group()):
            continue
        left, at = [], m.start()
        for k in range(bisect_left(end, m.start() + 1), bisect_left(begin, m.end())):
            left.append((at, begin[k]))
            at = end[k]
        left = [(a, b) for a, b in [*left, (at, m.end())] if a < b]
        random = bool(left) and model.ratio(m.group()) > RATIO * len(m.group())
        spans += [(a, 3, b) for a, b in left if random or b - a >= LEAST and model.ratio(text[a:b]) > RATIO * (b - a)]
    return sorted(spans)


def sieve(texts: pa.Array | list[str | None]) -> list[bool]:
    """Whether a text can hold a span at all, by one pass of Arrow's own regular expressions."""
    texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
    return pc.fill_null(pc.match_substring_regex(texts, _SIEVE), False).to_pylist()


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by one mark."""
    out, at, last = [], 0, -1
    for a, _, b in spans:
        if a >= last:
            out += [text[max(at, 0) : a], mark]
        last = max(last, b)
        at = last
    return "".join([*out, text[at:]]) if spans else text


def scan_documents(docs: DataFrame, model: RandomStrings | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, spans array<struct<kind, start, end>>, redacted text; null text stays null)."""
    model = model or RandomStrings(builtin_samples())
    kinds = dict(docs.dtypes)
    names = [id_col, *keep]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                text = part.column("_text")
                texts = text.to_pylist()
                found = [find(t, model) if h else [] for t, h in zip(texts, sieve(text))]
                spans = pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in f] for f in found], span)
                clean = pa.array([redact(t, f) if f else t for t, f in zip(texts, found)], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], spans, clean], [*names, "spans", "redacted"])

    return map_arrow(docs.select(*names, docs[text_col].alias("_text")), run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", spans array<struct<kind:string,start:bigint,end:bigint>>, redacted string")


def digest_documents(docs: DataFrame, model: RandomStrings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans string): counts and digests alone leave the worker."""
    from pyspark.sql import functions as F

    found = scan_documents(docs, model, id_col, text_col).drop("redacted")
    word = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] != KINDS[3]), word), ",")
    return found.select(id_col, *map(count, KINDS[:3]), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", word), ",").alias("spans"))
