"""Personal data: exact base patterns, and a semi-Markov conditional random field for what they miss.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. The field adds spans of its
own kinds: `credential` (keys, tokens, passwords), `number` (telephone numbers written without a plus)
and `address` (mail addresses spelt out with words such as "at" and "dot"). It cuts a text's tokens into
segments: single tokens outside, or an entity of at most LONGEST tokens. Features look at a segment as a
whole (its digits, letters, marks, length, the words around it), and dynamic programming picks
boundaries and kinds together. An entity must hold a trigger token (a digit, "@", "=", or the word
"dot"); elsewhere everything is outside, so only the surroundings of triggers are gone through.

Nobody has marked such spans in the corpus, so the field learns from sentences made by rule, with a
fixed seed, by gradient steps on the exact likelihood.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_batch

BASE = ("email", "ip", "card", "phone")
ADDED = ("credential", "number", "address")
KINDS = BASE + ADDED
LONGEST = 7

Span = tuple[int, int, str]

# ---- base patterns

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: A token: what stands between white space, cut at the marks that join names and values in URLs, JSON, CSV and code; with the quotes,
#: brackets and points beside it, as a word has them. ASCII and other letters apart.
_PIECE = re.compile(r"""["'(\[{<]*[^\s"'()\[\]{}<>=,;:&?|\x80-\U0010ffff]+["')\]}>]*[,;:]*|=|[\x80-\U0010ffff]+""")


def _emails(text: str) -> list[Span]:
    """Leftmost matches, one after another: the run of local characters before an @, then the domain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            free = m.end()
            out.append((begin, free, "email"))
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) by start, then kind; in code points, end exclusive."""
    out = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 10 <= sum(c in string.digits for c in m[0]) <= 15:
                out.append((*m.span(), "phone"))
    return _sorted(out)


def _sorted(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# ---- features of whole segments

#: Fixed words that announce a kind.
_SECRET_WORDS = frozenset("token key secret password passwd pwd api_key apikey access_key auth bearer credential".split())
_PHONE_WORDS = frozenset("call phone tel telephone mobile fax cell dial".split())
_MAIL_WORDS = frozenset("mail email e-mail write contact".split())
#: And those before numbers and digests that are nobody's.
_DIGEST_WORDS = frozenset("sha1 sha256 sha512 md5 sha checksum digest hash commit revision etag fingerprint".split())
_ID_WORDS = frozenset("order invoice ticket no nr number ref reference id isbn issn doi version page chapter line case article item batch serial model year code".split())
_TRIGGER = re.compile(r"[0-9@=]|^[(\[]?dot[)\]]?$", re.IGNORECASE)
_EDGES = ".,;:!?\"'()[]{}<>"
_FIGURES = re.compile(r"[0-9()+./-]+")
_DATE, _DECIMAL, _HEX = re.compile(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"), re.compile(r"\d+[.,]\d+"), re.compile(r"[0-9a-fA-F]+")

FEATURES = (
    "bias", "tokens1", "tokens2", "tokens3", "tokens4", "tokens5+", "digits0", "digits1-6", "digits7-8", "digits9-11", "digits12-15", "digits16+",
    "long", "hex", "upper_mix", "lower_mix", "case_mix", "mix", "quoted", "only_equals", "at", "at_word", "dot_word", "at_and_dot", "all_figures",
    "plus", "dashes", "points", "slash_or_colon", "path", "date", "money", "decimal", "first_has_digit", "last_has_digit", "first_edge", "inner_edge",
    "secret_before", "phone_before", "mail_before", "digest_before", "id_before", "equals_before", "digit_before", "digit_after", "word_ends", "plain_inside",
)
_DIGITS = (0, 1, 7, 9, 12, 16)


def _word(token: str) -> str:
    return token.strip(_EDGES + "=").lower()


class _Tokens:
    """What the features of all segments need to know of each token, as sums up to each place."""

    def __init__(self, tokens: list[str]) -> None:
        n = self.n = len(tokens)
        cores, words = [t.strip(_EDGES) for t in tokens], [_word(t) for t in tokens]
        flag = lambda test: np.fromiter(map(test, tokens, cores, words), bool, n)
        some = [any(c in string.digits for c in x) and any(c.isalpha() for c in x) for x in cores]
        self.digits = np.concatenate([[0], np.cumsum([sum(map(t.count, string.digits)) for t in tokens], dtype=np.int64)])
        self.flags = {
            "long": flag(lambda t, c, w: len(c) >= 16), "hex": flag(lambda t, c, w: len(c) >= 16 and _HEX.fullmatch(c) is not None),
            "mix": np.array(some, bool), "upper_mix": np.array([x and c.isalnum() and c.isupper() for x, c in zip(some, cores, strict=True)], bool),
            "lower_mix": np.array([x and c.isalnum() and c.islower() for x, c in zip(some, cores, strict=True)], bool),
            "case_mix": np.array([x and len(c) >= 16 and c.lower() != c and c.upper() != c for x, c in zip(some, cores, strict=True)], bool),
            "quoted": flag(lambda t, c, w: t[0] in "\"'" and len(c) > 1), "only_equals": flag(lambda t, c, w: c in ("=", ":=")),
            "date": flag(lambda t, c, w: _DATE.fullmatch(c) is not None), "decimal": flag(lambda t, c, w: _DECIMAL.fullmatch(c) is not None),
            "path": flag(lambda t, c, w: c.count("/") > 0 and any(x.isalpha() for x in c)), "at": flag(lambda t, c, w: "@" in t),
            "at_word": flag(lambda t, c, w: w == "at"), "dot_word": flag(lambda t, c, w: w == "dot"),
            "figures": flag(lambda t, c, w: _FIGURES.fullmatch(t.strip(",;:!?")) is not None), "figures_only": flag(lambda t, c, w: _FIGURES.fullmatch(t) is not None),
            "figures_after": flag(lambda t, c, w: _FIGURES.fullmatch(t.rstrip(".,;")) is not None), "plus": flag(lambda t, c, w: t[0] == "+"),
            "dashes": flag(lambda t, c, w: "-" in c), "points": flag(lambda t, c, w: "." in c), "slash_or_colon": flag(lambda t, c, w: "/" in c or ":" in c),
            "money": flag(lambda t, c, w: any(x in t for x in "$€£%")), "digit": self.digits[1:] > self.digits[:-1], "edge": flag(lambda t, c, w: t[-1] in ".,;:!?"),
            "secret": flag(lambda t, c, w: w in _SECRET_WORDS), "phone": flag(lambda t, c, w: w in _PHONE_WORDS), "mail": flag(lambda t, c, w: w in _MAIL_WORDS),
            "digest": flag(lambda t, c, w: w in _DIGEST_WORDS), "id": flag(lambda t, c, w: w in _ID_WORDS), "equals": flag(lambda t, c, w: t[-1] == "="),
            "plain": flag(lambda t, c, w: w.isalpha() and w not in ("at", "dot")), "hot": flag(lambda t, c, w: _TRIGGER.search(t) is not None),
        }
        self.sums = {k: np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for k, x in self.flags.items()}
        later = np.full(n + 1, n)
        for i in range(n - 1, -1, -1):
            later[i] = i if self.flags["at_word"][i] else later[i + 1]
        self.next_at = later

    def features(self, size: int) -> np.ndarray:
        """(start, feature) of all segments of so many tokens: whole-span features, True where they hold."""
        n, flags, sums = self.n - size + 1, self.flags, self.sums
        i = np.arange(n)
        j = i + size

        def among(name: str, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
            begin, end = np.minimum(np.maximum(begin, 0), self.n), np.minimum(np.maximum(end, 0), self.n)
            return np.maximum(sums[name][end] - sums[name][begin], 0)

        digits, single = self.digits[j] - self.digits[i], size == 1
        f = {"bias": np.ones(n, bool), f"tokens{size}" if size < 5 else "tokens5+": np.ones(n, bool)}
        for name, least, most in zip(FEATURES[6:12], _DIGITS, (*_DIGITS[1:], 1 << 62), strict=True):
            f[name] = (digits >= least) & (digits < most)
        for name in ("long", "hex", "upper_mix", "lower_mix", "case_mix", "mix", "quoted", "only_equals", "date", "decimal") if single else ():
            f[name] = flags[name]
        for name in ("at", "dashes", "points", "slash_or_colon", "path", "money"):
            f[name] = among(name, i, j) > 0
        f["at_word"], f["dot_word"] = among("at_word", i + 1, j - 1) > 0, among("dot_word", i + 1, j - 1) > 0
        f["at_and_dot"] = f["at_word"] & (among("dot_word", self.next_at[np.minimum(i + 1, self.n)] + 1, j - 1) > 0)
        f["all_figures"], f["plus"] = among("figures", i, j) == size, flags["plus"][i]
        f["first_has_digit"], f["last_has_digit"], f["word_ends"] = flags["digit"][i], flags["digit"][j - 1], flags["edge"][j - 1]
        f["first_edge"], f["inner_edge"] = flags["edge"][i] & (not single), among("edge", i, j - 1) > 0
        for name in ("secret", "phone", "mail", "digest", "id"):
            f[f"{name}_before"] = among(name, i - 3, i) > 0
        f["equals_before"], f["digit_before"] = (i > 0) & flags["equals"][i - 1], (i > 0) & flags["figures_only"][i - 1]
        f["digit_after"] = (j < self.n) & flags["figures_after"][np.minimum(j, self.n - 1)]
        f["plain_inside"] = among("plain", i + 1, j - 1) > 0
        return np.stack([f.get(x, np.zeros(n, bool)) for x in FEATURES], axis=1)


def segment_features(tokens: list[str], i: int, j: int) -> list[int]:
    """The features that hold for tokens[i:j] among its neighbours."""
    return np.flatnonzero(_Tokens(tokens).features(j - i)[i]).tolist()


# ---- the field: weights[kind, feature] of entities, moves[before, kind]; kind 0 is outside with score 0


def _segments(tokens: list[str]) -> list[tuple[int, int, np.ndarray]]:
    """All segments that may be an entity, with their features: at most LONGEST tokens, a trigger among them."""
    known, out = _Tokens(tokens), []
    for size in range(1, min(len(tokens), LONGEST) + 1):
        held, hot = known.features(size), known.sums["hot"]
        out += [(i, i + size, np.flatnonzero(held[i])) for i in range(len(held)) if hot[i + size] > hot[i]]
    return sorted(out, key=lambda x: x[:2])


def _scored(segments: list, weights: np.ndarray) -> list[list[tuple[int, int, np.ndarray]]]:
    """By end: (segment's number, start, score of each entity kind)."""
    end: dict[int, list] = {}
    for n, (i, j, f) in enumerate(segments):
        end.setdefault(j, []).append((n, i, weights[:, f].sum(1)))
    return end


def _likelihood(size: int, segments: list, weights: np.ndarray, moves: np.ndarray, gold: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood of the segmentation `gold` (start, end, kind; kind 0 of one token) by weights and moves."""
    end, k = _scored(segments, weights), len(moves)
    ahead = np.full((size + 1, k), -np.inf)
    ahead[0, 0] = 0
    come = [np.logaddexp.reduce(ahead[0][:, None] + moves, 0)]
    for j in range(1, size + 1):
        ahead[j, 0] = come[j - 1][0]
        for _, i, s in end.get(j, ()):
            ahead[j, 1:] = np.logaddexp(ahead[j, 1:], come[i][1:] + s)
        come.append(np.logaddexp.reduce(ahead[j][:, None] + moves, 0))
    total = np.logaddexp.reduce(ahead[size])
    back = np.full((size + 1, k), -np.inf)
    back[size] = 0
    start: dict[int, list] = {}
    for j, found in end.items():
        for n, i, s in found:
            start.setdefault(i, []).append((n, j, s))
    up_w, up_m = np.zeros_like(weights), np.zeros_like(moves)
    for i in range(size - 1, -1, -1):
        reach = np.full(k, -np.inf)  # of beginning a segment of a kind here
        reach[0] = back[i + 1, 0]
        for n, j, s in start.get(i, ()):
            value = s + back[j, 1:]
            reach[1:] = np.logaddexp(reach[1:], value)
            chance = np.exp(come[i][1:] + value - total)
            up_w[:, segments[n][2]] -= chance[:, None]
        both = ahead[i][:, None] + moves + reach[None, :]
        up_m -= np.exp(both - total)
        back[i] = np.logaddexp.reduce(moves + reach[None, :], 1)
    number, last = {(i, j): n for n, (i, j, _) in enumerate(segments)}, 0
    for i, j, kind in gold:
        up_m[last, kind] += 1
        last = kind
        if kind:
            up_w[kind - 1, segments[number[i, j]][2]] += 1
    return up_w, up_m


def best_path(tokens: list[str], weights: np.ndarray, moves: np.ndarray) -> list[tuple[int, int, int]]:
    """The entities (start, end, kind) of the best segmentation: all sizes and kinds that end at a place are weighed at once."""
    n, k, known = len(tokens), len(moves), _Tokens(tokens)
    if not n:
        return []
    # worth[j, size - 1]: of the segment of so many tokens that ends at j, for each entity kind
    worth = np.full((n + 1, LONGEST, k - 1), -np.inf)
    for size in range(1, min(n, LONGEST) + 1):
        hot = known.sums["hot"][size:] > known.sums["hot"][: n - size + 1]
        worth[size:, size - 1][hot] = known.features(size)[hot] @ weights.T
    come = np.full((LONGEST + n + 1, k), -np.inf)  # the best way to a place, by the kind that begins there; in front nothing
    come[LONGEST], before = moves[0], np.zeros((n + 1, k), np.int64)
    chosen = np.zeros((n + 1, k - 1), np.int64)
    score = np.full(k, -np.inf)
    for j in range(1, n + 1):
        score[0] = come[LONGEST + j - 1, 0]
        value = come[j : LONGEST + j, 1:][::-1] + worth[j]
        chosen[j] = value.argmax(0)
        score[1:] = value[chosen[j], np.arange(k - 1)]
        ways = score[:, None] + moves
        before[j] = ways.argmax(0)
        come[LONGEST + j] = ways[before[j], np.arange(k)]
    out, j, y = [], n, int(score.argmax())
    while j:
        i = j - 1 - int(chosen[j, y - 1]) if y else j - 1
        if y:
            out.append((i, j, y))
        j, y = i, int(before[i, y])
    return out[::-1]


# ---- sentences made by rule


def _made(rng: random.Random) -> tuple[list[str], list[tuple[int, int, int]]]:
    def word(least: int = 2, most: int = 9) -> str:
        return "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(least, most)))

    def some(n: int, chars: str) -> str:
        return "".join(rng.choice(chars) for _ in range(n))

    def digits(n: int) -> str:
        return some(n, string.digits)

    def credential() -> tuple[list[str], list[str]]:
        name, mixed = rng.choice(sorted(_SECRET_WORDS)), string.ascii_letters + string.digits
        value = rng.choice(
            [lambda: some(rng.choice([32, 40, 64]), "0123456789abcdef"), lambda: some(rng.randint(12, 40), mixed) + digits(1), lambda: some(4, string.ascii_uppercase) + some(16, string.ascii_uppercase + string.digits) + "7",
             lambda: word(2, 3) + digits(2) + word(1, 3) + digits(1)]
        )()
        shape = rng.randrange(3) if len(value) >= 16 else 0
        if shape == 0:
            return [name, "="], [f'"{value}"' if rng.random() < 0.7 else value]
        if shape == 1:
            return [], [value]
        return [name + rng.choice(["", ":"])], [value]

    def number() -> tuple[list[str], list[str]]:
        cut = rng.choice([(3, 3, 4), (2, 4, 4), (4, 3, 3), (2, 2, 2, 2, 2), (3, 7), (5, 6)])
        parts = [digits(n) for n in cut]
        if rng.random() < 0.4:
            parts[0] = f"({parts[0]})"
        join = rng.choice([" ", "-", "."]) if parts[0][0] != "(" else " "
        own = join.join(parts).split(" ")
        if parts[0][0] == "(" and rng.random() < 0.7 and len(own) > 2:
            own = [own[0], "-".join(own[1:])]
        need = rng.random() < 0.6
        return ([rng.choice(sorted(_PHONE_WORDS)) + rng.choice(["", ":"])] if need else []), own

    def address() -> tuple[list[str], list[str]]:
        at, dot = rng.choice([("at", "dot"), ("(at)", "(dot)"), ("[at]", "[dot]")])
        tail = [dot, rng.choice(["com", "org", "net", "de", "fr", "es"])]
        own = [word(3, 8), at, word(3, 8), *tail]
        if rng.random() < 0.2:
            own[2:2] = [word(3, 5), dot]
        return ([rng.choice(sorted(_MAIL_WORDS))] if rng.random() < 0.5 else []), own

    def nothing() -> tuple[list[str], list[str]]:
        return rng.choice(
            [lambda: [f"{rng.randint(1900, 2030)}"], lambda: [f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/{rng.randint(1990, 2030)}"], lambda: [f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}"],
             lambda: [f"${digits(rng.randint(1, 5))}"], lambda: [digits(rng.randint(1, 6))], lambda: [f"{digits(2)}.{digits(2)}"], lambda: [f"v{digits(1)}.{digits(1)}"], lambda: ["page", digits(2), "of", digits(3)], lambda: ["at", digits(2) + ":" + digits(2)],
             lambda: [rng.choice(sorted(_DIGEST_WORDS)) + rng.choice(["", ":"]), some(rng.choice([32, 40, 64, 128]), "0123456789abcdef")], lambda: [rng.choice(sorted(_ID_WORDS)), some(rng.randint(1, 3), string.ascii_uppercase) + "-" + digits(4) + "-" + digits(5)],
             lambda: [rng.choice(sorted(_ID_WORDS)) + rng.choice(["", ":", "."]), digits(rng.randint(5, 13))], lambda: [rng.choice(sorted(_ID_WORDS)), "#" + digits(rng.randint(4, 10))], lambda: ["/" + "/".join(word() for _ in range(rng.randint(1, 5))) + "/" + word() + digits(rng.randint(1, 8))],
             lambda: ["https:", f"//{word()}.{word(2, 3)}/{word()}/{word()}-{digits(rng.randint(2, 9))}"], lambda: ["-".join(some(m, "0123456789abcdef") for m in (8, 4, 4, 4, 12))], lambda: [f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{digits(2)}:{digits(2)}:{digits(2)}Z"],
             lambda: [f'"{word()}":', f"{digits(rng.randint(1, 9))},"], lambda: [word(), "=", digits(rng.randint(1, 7))], lambda: [word(), "=", f'"{word()}"'],
             lambda: [digits(3), digits(3)], lambda: ["the", "dot", "on", word()], lambda: [word() + digits(1)], lambda: ["isbn", digits(13)], lambda: [f"{rng.randint(1, 99)},{digits(3)}"], lambda: [digits(2) + "%"]]
        )(), []

    tokens, gold = [], []
    for _ in range(rng.randint(1, 2)):
        kind = rng.choice([0, 0, 1, 2, 3])
        lead, own = (nothing, credential, number, address)[kind]()
        tokens += [word() for _ in range(rng.randint(1, 4))] + lead
        if own:
            gold.append((len(tokens), len(tokens) + len(own), kind))
            if rng.random() < 0.3:
                own[-1] += rng.choice([".", ",", "!!", "###"])
        tokens += own
    tokens += [word() for _ in range(rng.randint(1, 4))]
    pieces = [_PIECE.findall(t) for t in tokens]  # as texts are read
    at = np.concatenate([[0], np.cumsum([len(x) for x in pieces], dtype=np.int64)]).tolist()
    tokens, gold = [x for own in pieces for x in own], [(at[i], at[j], kind) for i, j, kind in gold]
    inside = {k for i, j, _ in gold for k in range(i, j)}
    return tokens, sorted([*gold, *((k, k + 1, 0) for k in range(len(tokens)) if k not in inside)])


@functools.lru_cache
def field(sentences: int = 600, epochs: int = 5, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """(weights, moves), learnt from made sentences; the same in every process."""
    rng, k = random.Random(seed), len(ADDED) + 1
    made = [_made(rng) for _ in range(sentences)]
    held = [(tokens, _segments(tokens), gold) for tokens, gold in made]
    weights, moves = np.zeros((k - 1, len(FEATURES))), np.zeros((k, k))
    weights[:, 0] = -2
    seen_w, seen_m = np.full(weights.shape, 1e-2), np.full(moves.shape, 1e-2)
    for _ in range(epochs):
        rng.shuffle(held)
        for tokens, segments, gold in held:
            up_w, up_m = _likelihood(len(tokens), segments, weights, moves, gold)
            up_w -= 1e-3 * weights
            up_m -= 1e-3 * moves
            seen_w += up_w**2
            seen_m += up_m**2
            weights += 0.3 * up_w / np.sqrt(seen_w)
            moves += 0.3 * up_m / np.sqrt(seen_m)
    return weights, moves


# ---- spans of whole texts

_ANY = re.compile(r"[0-9@=]|\bdot\b", re.IGNORECASE)
#: Tokens that are decoded at once, beside an overlap.
_STRETCH = 4000


def added_spans(text: str, weights: np.ndarray, moves: np.ndarray) -> list[Span]:
    """The field's spans. Only runs of tokens around triggers are decoded; nothing farther off can be in an entity."""
    if not _ANY.search(text):
        return []
    places, hot, marks = [m.span() for m in _PIECE.finditer(text)], [], _ANY.finditer(text)
    mark = next(marks).start()
    for k, (i, j) in enumerate(places):  # only pieces with a sign of a trigger are looked into
        while mark < i:
            mark = next((m.start() for m in marks), len(text))
        if mark < j and _TRIGGER.search(text[i:j]):
            hot.append(k)
    out: list[Span] = []
    n = 0
    while n < len(hot):
        first, last = max(0, hot[n] - LONGEST - 2), hot[n] + LONGEST
        n += 1
        while n < len(hot) and hot[n] - LONGEST - 2 <= last:
            last = hot[n] + LONGEST
            n += 1
        own = places[first : last + 1]
        tokens = [text[i:j] for i, j in own]
        for at in range(0, len(tokens), _STRETCH):  # a long list of figures is decoded in overlapping stretches
            skip, stop = max(0, at - 2 * LONGEST), at + _STRETCH
            some = tokens[skip:stop]
            # a stretch decides what begins from LONGEST before it to LONGEST before its end: it sees all of that
            least, most = at - LONGEST if at else 0, stop - LONGEST if stop < len(tokens) else len(tokens)
            for i, j, kind in best_path(some, weights, moves):
                if not least <= skip + i < most:
                    continue
                begin, end = own[skip + i][0], own[skip + j - 1][1]
                while end > begin and not text[end - 1].isalnum():
                    end -= 1
                while begin < end and text[begin] in "\"'[{<.,;:!?":
                    begin += 1
                if end > begin and (not out or begin >= out[-1][1]):
                    out.append((begin, end, ADDED[kind - 1]))
    return out


def all_spans(text: str, weights: np.ndarray, moves: np.ndarray) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): what the field adds must not touch a base span."""
    base, more = base_spans(text), []
    at, reach = 0, 0  # base spans that begin before the end of an added one, and how far these reach
    for span in added_spans(text, weights, moves):
        while at < len(base) and base[at][0] < span[1]:
            reach = max(reach, base[at][1])
            at += 1
        if reach <= span[0]:
            more.append(span)
    return base, _sorted(base + more) if more else base


def told(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{i}:{j}" for i, j, kind in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """text with each span replaced by its kind in angle brackets; spans that overlap become one, of the first one's kind."""
    out, at = [], 0
    for i, j, kind in spans:
        if i >= at:
            out += [text[at:i], f"<{kind.upper()}>"]
        at = max(at, j)
    return "".join([*out, text[at:]])


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row.

    The counts and the hash are of the base spans; `spans` holds the added ones too. A null text counts as
    empty. Places are code points of the whole text. Other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(field())
    schema = T.StructType([docs.schema[id_col], *T.StructType.fromDDL(FOUND)])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, hashes, spans = [], [], []
        for text in batch.column(1).to_pylist():
            base, every = all_spans(text or "", *held.value)
            counts.append([sum(s[2] == kind for s in base) for kind in BASE])
            hashes.append(hashlib.sha256(told(base).encode()).hexdigest())
            spans.append(told(every))
        columns = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(hashes, pa.string()), pa.array(spans, pa.string())], names=schema.names)

    return per_batch(docs.select(id_col, text_col), schema, work)


def _changed(docs: DataFrame, text_col: str, change: Callable[[str], str]) -> DataFrame:
    at = docs.columns.index(text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if t is None else change(t) for t in batch.column(at).to_pylist()]
        columns = list(batch.columns)
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return per_batch(docs, docs.schema, work)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with personal data in the text replaced by its kind; null texts stay null, all other columns stay.

    The length column, if there is one, is set to the new text's length.
    """
    held = docs.sparkSession.sparkContext.broadcast(field())
    out = _changed(docs, text_col, lambda t: redacted(t, all_spans(t, *held.value)[1]))
    if length_col in out.columns:
        kind = out.schema[length_col].dataType
        out = out.withColumn(length_col, F.length(text_col).cast(kind))
    return out.select(*docs.columns)
