"""Personal data in whole texts: fixed patterns, and a linear-chain conditional random field over
word-shape features that adds what the patterns miss.

Words are longest runs without white space. A word's shape is how many digits, letters and signs of
each sort it has, on coarse scales, and what it begins and ends with; the field's features are the
shapes of a word and of its two neighbours, and pairs of neighbouring labels. It is trained on the
driver from a small labelled table (labelled_table(), or rows of the caller's) by gradient ascent on the
penalised conditional likelihood, and decoded by Viterbi in numpy batches.

Decoding covers every word. A span of the best path gains at least as much as the same words would
outside; a bound on each word's share of such a gain is summed over stretches, and a word that lies in no
stretch with a sum of zero or more is outside in every best path. The stretches between such words are the
chains that Viterbi decodes, many at a time. That cut is exact and leaves few words in ordinary prose.

Spans are code-point offsets, end exclusive. Added spans have the same kinds as the base ones; one that
meets a base span is dropped, so the base spans stay as they are.

Defined results: null and empty texts have no spans; repeated rows keep a row each; an empty table gives
an empty result; other columns are ignored. A text of any length is read whole.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm import text_hash
from barloom.llm.shared import texts_of

# The base patterns, in their given order.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match that begins inside a run of digits exists only where one begins at the run's first digit, so only
#: those places are tried: a long run is read once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, sign in enumerate(reversed(digits)):
        value = ord(sign) - 48
        if k % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def in_byte(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' leftmost non-overlapping matches that pass, by start, then kind.
    An address is found from its @: the local part is the run of its signs before, back to the last match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append((start, 0, done))
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(map(in_byte, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(sign.isdigit() for sign in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- word shapes ---------------------------------------------------------------------------------

#: A ten-bit counter in a word's total for each sort of sign: digits, letters, dots, dashes, at signs, others.
_SORTS = 6
_COUNT = np.full(256, 5, np.uint64)
_COUNT[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_COUNT[48:58] = 0
_COUNT[ord(".")] = 2
_COUNT[ord("-")] = 3
_COUNT[ord("@")] = 4
_ONE = np.uint64(1) << (_COUNT * np.uint64(10))
_END = np.full(256, 7, np.int64)
_END[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
_END[48:58] = 1
for _k, _signs in enumerate(("(<[\"'", ")>]", "+", ".,;:!?", "-"), 2):
    _END[[ord(s) for s in _signs]] = _k
_DIGITS = np.minimum(np.arange(1024), 20)
_DIGITS = np.array([0, 1, 2, 3, 4, 5, 5, 6, 6, 6, 7, 7, 8, 8, 8, 9, 9, 10, 10, 10, 11])[_DIGITS]
_FEW = np.minimum(np.arange(1024), 4)
#: Sizes of the shape's features: digits, letters, dots, dashes, at signs, others; begin, end; digits and dots; digits and dashes.
SIZES = (12, 4, 5, 4, 3, 5, 8, 8, 60, 48)
_FEATURES = sum(SIZES)
_KEYS = (12, 4, 5, 4, 3, 5, 8, 8)


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One number for each word's shape."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_ONE[data])])
    total = sums[ends] - sums[starts]
    for k in np.flatnonzero(ends - starts > 1000).tolist():  # the counters would run over
        many = np.minimum(np.bincount(_COUNT[data[starts[k] : ends[k]]].astype(np.int64), minlength=_SORTS), 1023)
        total[k] = sum(int(n) << 10 * sort for sort, n in enumerate(many))
    count = [(total >> np.uint64(10 * k) & np.uint64(1023)).astype(np.int64) for k in range(_SORTS)]
    parts = (_DIGITS[count[0]], np.minimum(count[1], 3), _FEW[count[2]], np.minimum(count[3], 3), np.minimum(count[4], 2), _FEW[count[5]], _END[data[starts]], _END[data[ends - 1]])
    key = np.zeros(len(starts), np.int64)
    for part, size in zip(parts, _KEYS):
        key = key * size + part
    return key


def shape_features(key: np.ndarray) -> np.ndarray:
    """Feature numbers of each shape, a row of len(SIZES)."""
    parts, rest = [], key.copy()
    for size in reversed(_KEYS):
        rest, part = np.divmod(rest, size)
        parts.append(part)
    parts.reverse()
    parts += [parts[0] * 5 + parts[2], parts[0] * 4 + parts[3]]
    return np.stack([part + start for part, start in zip(parts, np.cumsum([0, *SIZES[:-1]]))], axis=1)


# --- the labelled table --------------------------------------------------------------------------

LABELS = ("O", *(f"{b}-{kind}" for kind in KINDS for b in "BI"))
#: Labelled sentences; # is any digit, $ any letter, and {kind:...} marks a span.
TEMPLATES = (
    "please write to {email:$$$$.$$$$@$$$$$.com} today",
    "mail {email:$$$$##@$$$$.example.com} , or call",
    "contact : {email:$$.##@mail#.example.com}",
    "her address is <{email:$$$_$$$@$$$.$$$.org}> .",
    "send it to ({email:$$$@$$$$$$.net})",
    "and so it ends.{email:##@mail#.example.com} is the address",
    "the {email:$$$+$$$@$$.io}, then",
    "call {phone:(###) 555-####} after noon",
    "my number : {phone:###-###-####} .",
    "tel. {phone:###.###.####} ext 12",
    "{phone:+# (###) 555-####} the office",
    "reach us on {phone:+## ## #### ####} or",
    "dial {phone:+###########} now",
    "phone {phone:(###)###-####}, fax",
    "ring {phone:+##-###-###-####} at once",
    "my phone is {phone:###-###-####}.",
    "fax {phone:###.###.####}; or ring {phone:###-###-####}.",
    "they answer at {phone:(###) ###-####}, as ever",
    "card {card:################} was charged",
    "the card is {card:####-####-####-####}.",
    "it says {card:#### #### #### ####}.",
    "paid with {card:#### #### #### ####} yesterday",
    "number {card:####-####-####-####} expires",
    "the {card:###############} amex card",
    "use {card:################} for the order",
    "host {ip:##.##.###.##} is down",
    "from {ip:###.##.#.#} to {ip:10.#.#.##}",
    "ping {ip:192.168.#.##}, then wait",
    "server ({ip:###.###.##.##}) replied",
    "| {ip:###.##.##.###} | up |",
    "Licensed under the Apache License , Version 2.0.",
    "in #### there were ### people and ## cars",
    "on ##/##/20## at ##:## we met",
    "on 20##-##-## the price was $#,###.##",
    "it costs #.## or ##,### in all",
    "see section #.#.# and page ##-##",
    "checksum = \"##$$##$$####$$$$##$$##$$##$$##$$########\" of it",
    "password : $$$##$$##",
    "isbn 978-#-##-######-# of the book",
    "order ######## shipped in # boxes",
    "build ########.## passed",
    "the pi is #.########",
    "a b c # ## ### #### d e",
    "version #.##.#-$$## of it",
    "the model $$$-#### and $##",
    "rows ##x## with #% loss and ##%",
    "--- === ~~~ ^^^ a line ///",
    "STOP!! READ!! THIS!! FIRST!!",
    "very*** loud*** signs&&& all### round%%%",
    "name | colour | price | weight. |",
    "apples , pears. Plums at @ each",
    "Is @home or @$$$$ there ?",
    "the well-known e-mail and co-op (see below) :",
    "von dem schön und über geht's nicht",
    "http://$$$$.$$$/$$$$?id=#### is a link",
    "www.$$$$$.com and $$$.$$$.org",
    "# #. ## ##. ###, ####;",
    "lines ### - ### of ####",
    "temperatures of -## to +## degrees",
    "a ratio of ## : ## and #.# + #.#",
    "phone calls and card games and mail",
    "chapter ## , verse ##-## , number ###",
    "##th of may , #### ; the ##st one",
    "commit ##$$##$ by $$$",
)


def labelled_table(copies: int = 6, seed: int = 20240503) -> list[tuple[list[str], list[str]]]:
    """(words, labels) of each labelled sentence: the templates with digits and letters drawn anew."""
    rng = np.random.Generator(np.random.PCG64(seed))
    rows = []
    for _ in range(copies):
        for template in TEMPLATES:
            marked = re.sub(r"#", lambda _: str(rng.integers(10)), template)
            marked = re.sub(r"\$(?![#0-9,.])", lambda _: chr(97 + rng.integers(26)), marked)
            words: list[str] = []
            labels: list[str] = []
            for piece in re.split(r"(\S*\{\w+:[^}]*\}\S*)", marked):
                m = re.fullmatch(r"(\S*)\{(\w+):([^}]*)\}(\S*)", piece)
                new = (m[1] + m[3] + m[4]).split() if m else piece.split()
                words += new
                labels += [f"{'I' if k else 'B'}-{m[2]}" for k in range(len(new))] if m else ["O"] * len(new)
            rows.append((words, labels))
    return rows


# --- the field -----------------------------------------------------------------------------------


@dataclass
class Field:
    """own, before, after: the features' weights for a word's label from its own shape and from its
    neighbours'; moves: weights of label pairs. Row _FEATURES of before and after stands for no neighbour."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    moves: np.ndarray

    def tables(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each shape's share of the emissions of its own word, of the next and of the previous word."""
        f = shape_features(key)
        return self.own[f].sum(1), self.before[f].sum(1), self.after[f].sum(1)

    def gains(self) -> np.ndarray:
        """Of each label, the most that transitions give its word, against "outside", in a span (a first label and
        the inner ones of its kind): on entering and leaving the span, or from the span's word before it."""
        m, inner = self.moves, [LABELS.index(f"I-{label[2:]}") if k else 0 for k, label in enumerate(LABELS)]
        leave = max((m[y, q] - m[0, q] for y in range(1, len(LABELS)) for q in range(len(LABELS)) if q != inner[y]), default=0.0)
        enter = (m - m[:, :1]).max(0) + leave
        for y in range(1, len(LABELS)):
            if y == inner[y]:
                enter[y] = max((m[p, y] - m[p, 0] + leave for p in range(len(LABELS)) if inner[p] != y), default=0.0)
                enter[y] = max(enter[y], *(m[p, y] - m[0, 0] for p in range(1, len(LABELS)) if inner[p] == y))
        return enter

    def emissions(self, key: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        kinds, at = np.unique(key, return_inverse=True)
        own, before, after = self.tables(kinds)
        out = own[at]
        out[1:] += np.where(first[1:, None], self.before[_FEATURES], before[at[:-1]])
        out[:-1] += np.where(last[:-1, None], self.after[_FEATURES], after[at[1:]])
        if len(out):
            out[0] += self.before[_FEATURES]
            out[-1] += self.after[_FEATURES]
        return out


def _edges(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    change = rows[1:] != rows[:-1]
    return np.concatenate([[True], change])[: len(rows)], np.concatenate([change, [True]])[: len(rows)]


def train(table: list[tuple[list[str], list[str]]], steps: int = 150, penalty: float = 2e-3) -> Field:
    """Maximum conditional likelihood by Adam; sentences are padded into one batch."""
    n, width, size = len(table), max(len(w) for w, _ in table), len(LABELS)
    f = np.zeros((n, width, len(SIZES)), np.int64)
    y = np.zeros((n, width), np.int64)
    lengths = np.array([len(w) for w, _ in table])
    for k, (words, labels) in enumerate(table):
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        starts, ends, _ = text_hash.word_spans(data, np.array([0, len(data)]))
        f[k, : len(words)] = shape_features(shapes(data, starts, ends))
        y[k, : len(words)] = [LABELS.index(x) for x in labels]
    real = np.arange(width) < lengths[:, None]
    p = [np.zeros((_FEATURES + 1, size)), np.zeros((_FEATURES + 1, size)), np.zeros((_FEATURES + 1, size)), np.zeros((size, size))]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    none = np.full((n, 1, len(SIZES)), _FEATURES)
    prev, following = np.concatenate([none, f[:, :-1]], 1), np.concatenate([f[:, 1:], none], 1)
    following[np.arange(n), lengths - 1] = _FEATURES
    edge_weight = np.full(_FEATURES + 1, 1.0)
    edge_weight[_FEATURES] = 1 / len(SIZES)
    truth = np.eye(size)[y] * real[..., None]
    pairs = real[:, 1:]

    def scaled(w: np.ndarray) -> np.ndarray:
        return w * edge_weight[:, None]

    for step in range(1, steps + 1):
        e = p[0][f].sum(2) + scaled(p[1])[prev].sum(2) + scaled(p[2])[following].sum(2)
        moves = p[3]
        a = np.zeros_like(e)
        a[:, 0] = e[:, 0]
        for t in range(1, width):
            new = np.logaddexp.reduce(a[:, t - 1, :, None] + moves, axis=1) + e[:, t]
            a[:, t] = np.where(real[:, t, None], new, a[:, t - 1])
        b = np.zeros_like(e)
        for t in range(width - 2, -1, -1):
            new = np.logaddexp.reduce(moves + (e[:, t + 1] + b[:, t + 1])[:, None, :], axis=2)
            b[:, t] = np.where(real[:, t + 1, None], new, 0)
        z = np.logaddexp.reduce(a[:, -1], axis=1)
        off = truth - np.exp(a + b - z[:, None, None]) * real[..., None]
        both = np.exp(a[:, :-1, :, None] + moves + (e + b)[:, 1:, None, :] - z[:, None, None, None]) * pairs[..., None, None]
        seen = np.einsum("nti,ntj->ij", truth[:, :-1] * pairs[..., None], truth[:, 1:])
        grads = [np.zeros_like(x) for x in p]
        for g, index in zip(grads, (f, prev, following)):
            for k in range(len(SIZES)):
                np.add.at(g, index[:, :, k], off)
        grads[1], grads[2] = scaled(grads[1]), scaled(grads[2])
        grads[3] = seen - both.sum((0, 1))
        for k, (w, g) in enumerate(zip(p, grads)):
            g = g / n - penalty * w
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            w += 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    # An inner label follows its own kind only.
    for k, label in enumerate(LABELS):
        if label[0] == "I":
            for j, other in enumerate(LABELS):
                if other[2:] != label[2:]:
                    p[3][j, k] = -30.0
    return Field(*p)


def viterbi(e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Labels of the words in chains e[start : start + length], each with "outside" before and after it.
    Chains go together, longest first; at each step those that have ended drop out."""
    labels = np.zeros(len(e), np.int64)
    by = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[by], lengths[by]
    going = len(starts)
    score = np.where(np.arange(len(LABELS)) == 0, 0.0, -1e9) + np.zeros((going, len(LABELS)))
    back = []
    for t in range(int(lengths[0]) if going else 0):
        going = int(np.searchsorted(-lengths, -t, "left"))
        paths = score[:going, :, None] + moves
        best = paths.argmax(1)
        back.append(best.astype(np.int8))
        score[:going] = np.take_along_axis(paths, best[:, None, :], 1)[:, 0] + e[starts[:going] + t]
    now = (score + moves[:, 0]).argmax(1)
    for t in range(len(back) - 1, -1, -1):
        rows = np.arange(len(back[t]))
        labels[starts[rows] + t] = now[rows]
        now[rows] = back[t][rows, now[rows]]
    return labels


def decode(field: Field, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row, kind, start, end) in bytes from the slice's beginning of the spans that the field finds."""
    starts, ends, rows = text_hash.word_spans(data, offsets)
    if not len(starts):
        return
    key = shapes(data, starts, ends)
    kinds, at = np.unique(key, return_inverse=True)
    first, last = _edges(rows)
    own, before, after = field.tables(kinds)
    none = len(kinds)
    prev, following = np.where(first, none, np.roll(at, 1)), np.where(last, none, np.roll(at, -1))
    before = np.vstack([before, field.before[_FEATURES]])
    after = np.vstack([after, field.after[_FEATURES]])
    triple, of = np.unique((prev * (none + 1) + at) * (none + 1) + following, return_inverse=True)
    e = before[triple // (none + 1) ** 2] + own[triple // (none + 1) % (none + 1)] + after[triple % (none + 1)]
    moves = field.moves
    share = (e[:, 1:] - e[:, :1] + field.gains()[1:]).max(1)[of]
    # Of all stretches that hold a word, the largest sum; some may cross texts, which marks more words only.
    sums = np.concatenate([[0.0], np.cumsum(share)])
    until = sums[1:] - np.minimum.accumulate(sums[:-1])
    since = np.maximum.accumulate(sums[:0:-1])[::-1] - sums[:-1]
    hard = np.flatnonzero(until + since - share >= -1e-6)
    if not len(hard):
        return
    new = np.concatenate([[True], (hard[1:] != hard[:-1] + 1) | first[hard[1:]]])
    chain = np.flatnonzero(new)
    labels = viterbi(e[of[hard]], chain, np.diff(np.append(chain, len(hard))), moves)
    k = 0
    while k < len(hard):
        step = 1
        if labels[k]:
            kind = (labels[k] - 1) // 2
            while k + step < len(hard) and not new[k + step] and labels[k + step] == 2 * kind + 2:
                step += 1
            yield int(rows[hard[k]]), int(kind), int(starts[hard[k]]), int(ends[hard[k + step - 1]])
        k += step


_WHITE = "".join(sign for sign in map(chr, range(0x3001)) if sign.isspace())


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without surrounding quotes, brackets and stops; a bracket that is closed inside stays."""
    word = text[start:end].lstrip(_WHITE + "<>\"'([")
    a, b = end - len(word), end - len(word) + len(word.rstrip(_WHITE + "<>\"'].,;:!?|"))
    if a > start and text[a - 1] == "(" and ")" in text[a:b]:
        a -= 1
    if b > a and text[b - 1] == ")" and "(" not in text[a:b]:
        b -= 1
    return a, b


def plausible(kind: int, text: str) -> bool:
    """What an added span must have: an address its sign, an ip four parts of at most 255, digits as many as the
    kind takes, a card's check sum."""
    numbers = re.findall("[0-9]+", text)
    digits = "".join(numbers)
    if kind == 0:
        return "@" in text
    if kind == 1:
        return text.count(".") == 3 and len(numbers) == 4 and all(in_byte(x) for x in numbers)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 7 <= len(digits) <= 15


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(docs: DataFrame, table: list[tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """One row for each row of docs: counts of the base kinds, the digest of the base spans, all spans,
    and how many of them the field added."""
    field = docs.sparkSession.sparkContext.broadcast(train(labelled_table() if table is None else table))
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_hash.byte_slices(batch.column(1)):
                added: dict[int, list[tuple[int, int, int]]] = {}
                for row, kind, start, end in decode(field.value, data, offsets):
                    added.setdefault(row, []).append((kind, start, end))
                # Code points before each byte.
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                signal = np.concatenate([[0], np.cumsum((data == 64) | ((data >= 48) & (data < 58)))])
                marked = signal[offsets[1:]] > signal[offsets[:-1]]
                rows = []
                for row in range(j - i):
                    if not marked[row]:
                        rows.append((0, 0, 0, 0, empty, "", 0))
                        continue
                    raw = data[offsets[row] : offsets[row + 1]].tobytes()
                    text = raw.decode("utf-8", "replace")
                    base = base_spans(text)
                    starts, reach, more = [x for x, _, _ in base], [0, *accumulate((y for _, _, y in base), max)], []
                    for kind, start, end in added.get(row, ()):
                        begin, until = (int(chars[at] - chars[offsets[row]]) for at in (start, end))
                        a, b = trimmed(text, begin, until)
                        if a < b and plausible(kind, text[a:b]) and reach[bisect_left(starts, b)] <= a:
                            more.append((a, kind, b))
                    counts = [sum(k == kind for _, k, _ in base) for kind in range(4)]
                    rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + more)), len(more)))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
                )

    return texts_of(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
