"""Secret scans: fixed patterns, and values in credential context that would be hard to guess.

Base spans: `assign` (a credential word, an assignment sign and a value of 6 characters or more), `access` (AKIA and
capitals or digits, 20 or more), `hex` (24 lower-case hexadecimal digits or more); per kind leftmost matches that
don't overlap, whole matches as code point spans. The method adds `guess` spans: values after a wider set of
credential words whose guess cost, taken over the whole value, is at least 10**MIN_COST; where base spans cover a part
of the value, the other parts are spans. A value in quotes ends at the closing quote of its line, any other at white space;
it may stand in the line after its sign. Punctuation at its end counts for no cost, but belongs to the span.

Guess cost: the least sum, over all segmentations of the value, of the log10 costs of its spans: words of a ranked list
(any case, and with digits or signs for letters), dates and years, repeats of the last 1 to 4 characters, keyboard walks, and brute force by
character class. Repeats and walks cost a start and a little a character, so one pass with a state for each of
them finds the least segmentation in time linear in the value's length.

The ranked list is a parameter: ranked_words() makes one from vocabulary files, whose paths are parameters too. The
cost alone decides: a value's length or kind of characters rules nothing out.

Plan: one scan of the texts, no shuffle; the list is broadcast (its size is checked). Byte searches for the few literals that any match needs come first; only
texts that have one go through the patterns.

Defined cases: null counts as empty; empty texts have no spans; texts and values of any length are searched whole;
spans of equal start are listed by kind; repeated rows get a row each; an empty table gives an empty result; other
columns, whatever their names, are unread. redact() passes all columns through.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ADDED, apart, each_text, field, restored, scan_texts

MIN_COST, MAX_WORDS = 9.0, 2_000_000
#: Values whose costs a task remembers, and the longest of them.
REMEMBERED, REMEMBERED_LENGTH = 4096, 64
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words that announce a credential, in the languages of the corpus; a parameter of scan() and redact().
CONTEXTS = ("password", "passwd", "passphrase", "pass", "pwd", "secret", "token", "api[ _-]?key", "private[ _-]?key", "credentials?", "auth", "login", "passwort", "kennwort", "contrase[ñÑ]a", "clave", "mot de passe", "senha", "wachtwoord")
#: Lower-cased bytes, one of which any match of the patterns above holds.
ASSIGN_NEEDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: A value goes from one quote to the next in its line or, without quotes, to white space.
VALUE = r"""(?:"([^"\n]+)"|'([^'\n]+)'|["']?([^\s"']\S*))"""


def context_of(words: tuple[str, ...]) -> re.Pattern:
    """Any of the words (patterns of letters), a sign with the value behind it or in the next line, or a little English prose."""
    return re.compile(rf"""(?ai:(?<![a-z])(?:{"|".join(words)}))["']?\x20*(?:[:=][\x20\t]*(?:\r?\n[\x20\t]*)?|\bis\b\x20*){VALUE}""")


def needs_of(words: tuple[str, ...]) -> list[bytes]:
    """Lower-case letters, one of which stands in any text with a match: those that a word begins with."""
    begun = {m[0].encode() if (m := re.match(r"[a-z]+(?![?*{])", w)) else b"" for w in words}
    return sorted(x for x in begun if not any(y != x and x.startswith(y) for y in begun))


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
HEX_OR_SPACE = bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))

#: Frequent password words, most frequent first; they come before the words of a ranked list.
WORDS = """password secret token admin welcome login letmein master dragon monkey qwerty shadow sunshine princess
football baseball michael jordan superman batman trustno iloveyou hello freedom whatever ninja mustang access
flower hottie loveme starwars passw0rd computer internet service test example changeme default root user guest
demo sample placeholder private public server system database summer winter spring autumn monday friday january
february march april june july august september october november december the and for with this that from your
our have not are was one all you""".split()
#: The rows of the common keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
LEET = str.maketrans("4301$5@7", "aeoissat")
DATE = re.compile(r"(?:19|20)\d\d(?:[-./_]?(?:0[1-9]|1[0-2])[-./_]?(?:0[1-9]|[12]\d|3[01]))?|(?:0?[1-9]|[12]\d|3[01])[-./_](?:0?[1-9]|1[0-2])[-./_](?:(?:19|20)?\d\d)", re.ASCII)


def _neighbours() -> dict[str, str]:
    near: dict[str, set[str]] = {}
    for r, row in enumerate(ROWS):
        for c, key in enumerate(row):
            for dr, dc in ((0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)):
                if 0 <= r + dr < len(ROWS) and 0 <= c + dc < len(ROWS[r + dr]):
                    near.setdefault(key, set()).add(ROWS[r + dr][c + dc])
    return {k: "".join(sorted(v)) for k, v in near.items()}


NEAR = _neighbours()
WALK_START, WALK_STEP, REPEAT_START, REPEAT_STEP, PERIODS = math.log10(len(NEAR)) + 0.5, 0.35, 0.7, 0.01, (1, 2, 3, 4)


def ranked_words(word_bpe: str, piece_bpe: str) -> list[str]:
    """Frequent words, most frequent first: the whole words of three letters or more of two vocabularies (a JSON file of merged words, a SentencePiece file), by turns."""
    import sentencepiece

    with open(word_bpe, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    ended = [w.removesuffix("</w>") for w in sorted(vocabulary, key=vocabulary.get) if w.endswith("</w>")]
    model = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
    begun = [p[1:].lower() for p in map(model.id_to_piece, range(model.get_piece_size())) if p.startswith("\u2581")]
    lists = [[w for w in words if len(w) > 2 and w.isalpha()] for words in (ended, begun)]
    turns = [w for k in range(max(map(len, lists))) for words in lists for w in words[k : k + 1]]
    return list(dict.fromkeys(turns))


def brute(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 1000)


class Guesses:
    """Guess costs over one ranked list of words."""

    def __init__(self, words: list[str], contexts: tuple[str, ...] = CONTEXTS):
        self.context, self.needs = context_of(contexts), needs_of(contexts)
        self.rank = {w: math.log10(k + 2) for k, w in enumerate(dict.fromkeys([*WORDS, *words]))}
        self.longest = max(map(len, self.rank))
        self.known: dict[str, float] = {}

    def cost(self, value: str) -> float:
        """log10 of the guesses of the cheapest segmentation."""
        if (cost := self.known.get(value)) is None:
            cost = self.cheapest(value)
            if len(value) <= REMEMBERED_LENGTH:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[value] = cost
        return cost

    def cheapest(self, value: str) -> float:
        n, lower = len(value), value.lower().translate(SHIFTED)
        plain = value.lower().translate(LEET)
        plain = plain if len(plain) == n else value
        lower = lower if len(lower) == n else value
        free = [math.inf] * (n + 1)  # cheapest cost of value[:i], any last span
        free[0] = 0.0
        walk, copy = math.inf, [math.inf] * len(PERIODS)
        for i in range(n):
            start = free[i]
            for size in range(3, min(self.longest, n - i) + 1):
                for cased, extra in ((value[i : i + size].lower(), 0.0), (plain[i : i + size], 0.5)):
                    if (rank := self.rank.get(cased)) is not None:
                        cost = start + rank + extra + (0.3 if not value[i : i + size].islower() else 0.0)
                        free[i + size] = min(free[i + size], cost)
            if value[i].isdigit() and (m := DATE.match(value, i)):
                free[m.end()] = min(free[m.end()], start + (2.1 if m.end() - i == 4 else 4.6))
            if i and lower[i] in NEAR.get(lower[i - 1], ""):
                walk = min(walk, free[i - 1] + WALK_START) + WALK_STEP
            else:
                walk = math.inf
            for k, p in enumerate(PERIODS):
                copy[k] = min(copy[k], start + REPEAT_START) + REPEAT_STEP if i >= p and value[i] == value[i - p] else math.inf
            free[i + 1] = min(free[i + 1], start + brute(value[i]), walk, *copy)
        return free[n]


def find(text: bytes, guesses: Guesses) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all spans in code points, by start and then kind."""
    small, spans = text.translate(LOWER), []
    assign = any(x in small for x in ASSIGN_NEEDS)
    context = any(x in small for x in guesses.needs)
    access, hexes = b"AKIA" in text, b"h" * 24 in text.translate(HEX_OR_SPACE)
    if not (context or access or hexes):
        return []
    body = text.decode()
    if assign:
        spans += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(body) if m.end(2) - m.start(2) >= 6]
    if access:
        spans += [(m.start(), "access", m.end()) for m in ACCESS.finditer(body) if m.end() - m.start() >= 20]
    if hexes:
        spans += [(m.start(), "hex", m.end()) for m in HEX.finditer(body)]
    if context:
        spans += guessed(body, spans, guesses)
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))


def guessed(body: str, base: list[tuple[int, str, int]], guesses: Guesses) -> list[tuple[int, str, int]]:
    """The parts of hard values that no base span covers; values and base spans are walked once, side by side."""
    covered, out, at = united(base), [], 0
    for m in guesses.context.finditer(body):
        a, b = m.span(m.lastindex)
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        if (parts := outside(a, b, covered, at)) and guesses.cost(m[m.lastindex].rstrip(".,;!?)]}>\"'")) >= MIN_COST:
            out += [(x, "guess", y) for x, y in parts]
    return out


def united(spans: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """Disjoint stretches, in order, that cover what the spans cover."""
    out: list[tuple[int, int]] = []
    for a, _, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def outside(a: int, b: int, covered: list[tuple[int, int]], at: int = 0) -> list[tuple[int, int]]:
    """The parts of a stretch that no one of the disjoint sorted stretches from the at-th on covers."""
    parts = []
    while at < len(covered) and covered[at][0] < b:
        x, y = covered[at]
        if a < x:
            parts.append((a, x))
        a, at = max(a, y), at + 1
    return [*parts, (a, b)] if a < b else parts


SPAN_LIST = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def shared_words(docs: DataFrame, words: list[str]) -> Broadcast:
    if len(words) > MAX_WORDS:
        raise ValueError(f"a list of {len(words)} words is more than the {MAX_WORDS} that are broadcast")
    return docs.sparkSession.sparkContext.broadcast(words)


def scan(docs: DataFrame, keep: list[str], words: list[str], text_col: str = "text", contexts: tuple[str, ...] = CONTEXTS) -> DataFrame:
    """The `keep` columns and the list of spans (kind, start, end) under the ADDED prefix; words: a ranked list."""
    shared = shared_words(docs, words)

    def make():
        guesses = Guesses(shared.value, contexts)
        return lambda col: [pa.array([[{"kind": k, "start": a, "end": b} for a, k, b in find(t, guesses)] for t in each_text(col)], ARROW_SPANS)]

    return scan_texts(docs, text_col, keep, [T.StructField("spans", SPAN_LIST)], make)


def listed(spans, kinds: tuple[str, ...] = KINDS):
    """kind:start:end of the spans of some kinds, comma-joined."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def cut(text: str, spans: list[dict], mark: str) -> str:
    """The text with the union of the spans replaced, each stretch by the mark of its first span's kind."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], mark.format(kind=s["kind"])]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, words: list[str], *, text_col: str = "text", mark: str = "<{kind}>", contexts: tuple[str, ...] = CONTEXTS) -> DataFrame:
    """All documents, with every span of their texts replaced by its mark; null texts stay null. One scan finds and replaces."""
    own, names = apart(docs)
    text, shared = names[text_col], shared_words(docs, words)

    def make():
        guesses = Guesses(shared.value, contexts)

        def kernel(col: pa.Array) -> list[pa.Array]:
            found = {k: spans for k, t in enumerate(each_text(col)) if (spans := find(t, guesses))}
            if not found:
                return [col.cast(pa.string())]
            texts = col.to_pylist()
            for k, spans in found.items():
                texts[k] = cut(texts[k], [{"kind": kind, "start": a, "end": b} for a, kind, b in spans], mark)
            return [pa.array(texts, pa.string())]

        return kernel

    seen = scan_texts(own, text, [c for c in own.columns if c != text], [field("text", "string")], make)
    return restored(seen, names | {text_col: ADDED + "text"})
