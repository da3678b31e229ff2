"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions in numpy.

The base spans of e-mail addresses, IP addresses, card and phone numbers come from their patterns. The network adds spans that
the patterns miss (secrets such as keys and passwords, and spellings that no pattern has). It reads characters, folded to
CLASSES, in both directions; gates are piecewise linear. Emissions and transitions score B/I/O tags of each kind. It is trained
on labelled spans: at most `TRAIN_TEXTS` excerpts of the documents (by a hash of doc_id), with their own base spans and with made
personal data, and look-alikes that are none, written into them.

A text is read in windows of WINDOW characters that overlap by OVERLAP; each character takes its emissions from the window that
holds it deepest. So a document has one sequence of emissions, and one best tag sequence. Bounds on what a span may gain over no
span, within windows and across their borders, tell which stretches can hold spans at all; each such stretch is decoded as a whole
by Viterbi, and all others are known to be O throughout. Cards, phones and IP addresses pass their checks (Luhn, digit counts,
ranges); e-mail addresses and secrets stand by the network's own margin over no span, which is calibrated on made negatives. What
of a span lies outside the base spans is added.

Null texts are empty. Repeated rows each give a row. Without documents to learn from, made words are the background.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrel.llm import common

KINDS = ("email", "ip", "card", "phone", "secret")
#: Fixed by the contract; a lookbehind only saves starts that cannot match.
EMAIL_END = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_START = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

TRAIN_TEXTS, TRAIN_CHARS = 400, 3000
CLASSES, HIDDEN = 98, 8
TAGS = 1 + 2 * len(KINDS)
WINDOW, OVERLAP, TOGETHER = 512, 64, 1024
TRAIN_WINDOW, TRAIN_BATCH, TRAIN_STEPS = 80, 128, 320
#: Bytes of text that are read together.
PART_BYTES = 3_000_000
#: Made windows without personal data that the margins are calibrated on.
NEGATIVES = 4000


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, leftmost and not overlapping within a kind; those that fail their check are
    dropped. Ordered by start, then kind as listed."""
    out = []
    if "@" in text:
        done, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > done and EMAIL_START.match(text, start - 1):
                start -= 1
            m = EMAIL_END.match(text, at + 1) if start < at else None
            if m:
                out.append((start, m.end(), "email"))
                done = m.end()
            else:
                done = max(done, at + 1)
            at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        for m in PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


LIKE_IP = re.compile(r"[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)) ?[0-9]{1,3}){3}")


def plausible(text: str, kind: str) -> bool:
    """The exact check of a span that the network found. E-mail addresses and secrets stand by the network's margin; here it only counts
    that they are long enough, addresses of at most eight words, secrets with one run of ten characters without a blank."""
    digits = "".join(c for c in text if c in "0123456789")
    if kind == "ip":
        return bool(LIKE_IP.fullmatch(text)) and all(int(p) <= 255 for p in re.findall("[0-9]+", text))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 .\-/]", text)
    if kind == "phone":
        return 10 <= len(digits) <= 15 and bool(re.fullmatch(r"\+?[0-9(][0-9 ().\-/]+[0-9]", text)) and bool(re.search(r"[^0-9]", text)) and not plausible(text, "card")
    words = text.split()
    return sum(c.isalnum() for c in text) >= 6 and (len(words) <= 8 if kind == "email" else max(map(len, words)) >= 10)


# --- characters -----------------------------------------------------------------------------------------------------------------

#: Class of each code point below 128; all above are one class. 0 is padding.
_FOLD = np.array([c - 31 if 32 <= c < 127 else 96 for c in range(128)] + [97], dtype=np.uint8)


def classes(text: str) -> np.ndarray:
    return _FOLD[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), 128)]


# --- the network ----------------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    inputs: list[np.ndarray]  # for each direction (CLASSES, 4 * HIDDEN): input, forget, output gates and candidate
    recur: list[np.ndarray]  # (HIDDEN, 4 * HIDDEN)
    emit: np.ndarray  # (2 * HIDDEN, TAGS)
    emit_bias: np.ndarray
    trans: np.ndarray  # (from, to)
    allowed: np.ndarray
    margins: np.ndarray | None = None  # what a span of each kind must gain over no span


def _allowed() -> np.ndarray:
    """I follows B or I of its own kind alone."""
    ok = np.ones((TAGS, TAGS), dtype=bool)
    for k in range(2, TAGS, 2):
        ok[:, k] = False
        ok[k - 1, k] = ok[k, k] = True
    return ok


_clip = np.clip  # one pass, in place


def states(model: Model, x: np.ndarray, direction: int) -> np.ndarray:
    """Hidden states (T, HIDDEN, B) of windows x (T, B) of classes, without what training needs besides. Padding keeps them 0."""
    steps, size = x.shape
    c = np.zeros((HIDDEN, size), dtype=np.float32)
    h, t = np.zeros_like(c), np.empty_like(c)
    out = np.empty((steps, HIDDEN, size), dtype=np.float32)
    table = np.ascontiguousarray(model.inputs[direction].T.astype(np.float32))
    recur = np.ascontiguousarray(model.recur[direction].T.astype(np.float32))
    z, u = np.empty((4 * HIDDEN, size), dtype=np.float32), np.empty((4 * HIDDEN, size), dtype=np.float32)
    i, f, o, g = (z[k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
    zero, one, two = np.float32(0), np.float32(1), np.float32(2)
    for s in range(steps) if direction == 0 else range(steps - 1, -1, -1):
        np.take(table, x[s], axis=1, out=z, mode="clip")
        np.matmul(recur, h, out=u)
        np.add(z, u, out=z)
        _clip(z, zero, one, out=z)
        np.multiply(g, two, out=g)
        np.subtract(g, one, out=g)
        np.multiply(c, f, out=c)
        np.multiply(g, i, out=g)
        np.add(c, g, out=c)
        np.abs(c, out=t)
        np.add(t, one, out=t)
        np.divide(c, t, out=t)
        h = out[s]
        np.multiply(t, o, out=h)
    return out


def emissions(model: Model, x: np.ndarray) -> np.ndarray:
    """(T, TAGS, B) scores of windows x (T, B) of classes."""
    e = np.matmul(np.ascontiguousarray(model.emit[:HIDDEN].T.astype(np.float32)), states(model, x, 0))
    e += np.matmul(np.ascontiguousarray(model.emit[HIDDEN:].T.astype(np.float32)), states(model, x, 1))
    e += model.emit_bias.astype(np.float32)[:, None]
    return e


def transitions(model: Model) -> np.ndarray:
    return np.where(model.allowed, model.trans, -1e4).astype(np.float32)


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags (T, B) for emissions (T, TAGS, B). The start is an O. Of I's, only the ways in that are allowed are tried."""
    steps, _, size = e.shape
    scores = np.empty((steps + 1, TAGS, size), dtype=np.float32)
    scores[0] = -1e4
    scores[0, 0] = 0
    starts, inner = np.array([0, *range(1, TAGS, 2)]), np.arange(2, TAGS, 2)
    into = np.ascontiguousarray(trans[:, starts])[:, :, None]
    from_b, from_i = trans[inner - 1, inner][:, None], trans[inner, inner][:, None]
    both = np.empty((TAGS, len(starts), size), dtype=np.float32)
    for s in range(steps):
        last, new = scores[s], scores[s + 1]
        np.add(last[:, None], into, out=both)
        new[starts] = both.max(axis=0)
        new[inner] = np.maximum(last[1::2] + from_b, last[2::2] + from_i)
        new += e[s]
    tags = np.empty((steps, size), dtype=np.int8)
    tag = scores[-1].argmax(axis=0)
    columns = np.ascontiguousarray(trans.T)  # by tag: the ways in
    for s in range(steps - 1, -1, -1):
        tags[s] = tag
        tag = (scores[s] + columns[tag].T).argmax(axis=0)
    return tags


def gains(e: np.ndarray, trans: np.ndarray, kinds=range(len(KINDS))) -> tuple[np.ndarray, np.ndarray, float]:
    """What the best B, and the best I, of these kinds at each place (T, B) gains over O, with its way in; and the best way out of a
    span of any kind.

    A path's gain over all O is the sum over its spans: each pays its own way out, also where the next span follows at once, whose
    way in is taken less that.
    """
    o = trans[0, 0]
    way_out = np.concatenate([[0], trans[1:, 0] - o])
    to_b = (trans[:, 1::2] - o - way_out[:, None]).max(axis=0).astype(np.float32)
    to_i = np.array([max(trans[k - 1, k], trans[k, k]) - o for k in range(2, TAGS, 2)], dtype=np.float32)
    first, *others = kinds
    b, i = e[:, 1 + 2 * first] + to_b[first], e[:, 2 + 2 * first] + to_i[first]
    for k in others:
        np.maximum(b, e[:, 1 + 2 * k] + to_b[k], out=b)
        np.maximum(i, e[:, 2 + 2 * k] + to_i[k], out=i)
    b -= e[:, 0]
    i -= e[:, 0]
    return b, i, float(way_out[1:].max())


def bound(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """No span gains more than this, for each window; where it is not above 0, no path gains anything over the path all O."""
    b, i, way_out = gains(e, trans)
    return bounds(b, i, np.zeros(e.shape[2], dtype=np.int64), np.full(e.shape[2], len(e)))[0] + way_out


def bounds(b: np.ndarray, i: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of places low to high (not included) of each window, without the way out: the best of spans within; of spans that begin there and
    go on behind (tail); of what those that began before gain there (head), and what those that go right through gain (through)."""
    steps = np.arange(len(i))[:, None]
    outside = (steps < low) | (steps >= high)
    if outside.any():
        b, i = np.where(outside, np.float32(-1e4), b), np.where(outside, np.float32(0), i)
    sums = np.cumsum(i, axis=0)
    end = sums[-1]
    b = b - sums
    tail = b.max(axis=0) + end
    head = sums.max(axis=0) if not outside.any() else np.where(outside, np.float32(-1e4), sums).max(axis=0)
    np.maximum.accumulate(sums[::-1], axis=0, out=sums[::-1])
    return (b + sums).max(axis=0), tail, head, end


def windows_of(n: int) -> list[tuple[int, int, int, int]]:
    """(start, end, and from and to which place it counts) of the windows of a text of n characters."""
    out, start = [], 0
    while True:
        end = min(n, start + WINDOW)
        out.append((start, end, start + OVERLAP // 2 if start else 0, end - OVERLAP // 2 if end < n else n))
        if end == n:
            return out
        start += WINDOW - OVERLAP


def emitted(model: Model, codes: list[np.ndarray], windows: list[tuple], only: np.ndarray):
    """(window numbers, emissions (T, TAGS, B)) of the windows `only`, those of like length together."""
    for a in range(0, len(only), TOGETHER):
        part = only[a : a + TOGETHER]
        x = np.zeros((len(part), max(windows[w][2] - windows[w][1] for w in part)), dtype=np.uint8)
        for row, w in enumerate(part):
            k, start, end = windows[w][:3]
            x[row, : end - start] = codes[k][start:end]
        yield part, emissions(model, np.ascontiguousarray(x.T).astype(np.intp))


def network_spans(model: Model, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Spans of each text, from its best tag sequence, that gain the margin of their kind over no span; not checked."""
    return [[(a, b, kind) for a, b, kind, over in found if over >= model.margins[KINDS.index(kind)]] for found in weighed_spans(model, texts)]


def weighed_spans(model: Model, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
    """Spans of each text and what each gains over no span, from the best tag sequence of the whole text."""
    codes = [classes(text) for text in texts]
    windows = [(k, *w) for k, c in enumerate(codes) if len(c) for w in windows_of(len(c))]
    trans = transitions(model)
    by_length = np.array(sorted(range(len(windows)), key=lambda w: windows[w][1] - windows[w][2]), dtype=np.int64)
    inner, tail, head, through = (np.zeros(len(windows), dtype=np.float32) for _ in range(4))
    held: dict[int, np.ndarray] = {}

    def keep(part, e, columns):
        for column in columns.tolist():
            w = int(part[column])
            _, start, _, low, high = windows[w]
            held[w] = np.ascontiguousarray(e[low - start : high - start, :, column])

    for part, e in emitted(model, codes, windows, by_length):
        b, i, way_out = gains(e, trans)
        low, high = (np.array([windows[w][k] - windows[w][1] for w in part]) for k in (3, 4))
        inner[part], tail[part], head[part], through[part] = bounds(b, i, low, high)
        some = np.flatnonzero((inner[part] + way_out > 0) | (tail[part] > 0))
        if len(some):  # more closely, one kind at a time
            near = e[:, :, some]
            each = [bounds(*gains(near, trans, [k])[:2], low[some], high[some])[:2] for k in range(len(KINDS))]
            inner[part[some]], tail[part[some]] = np.max([x for x, _ in each], axis=0), np.max([x for _, x in each], axis=0)
            keep(part, e, some[(inner[part[some]] + way_out > 0) | (tail[part[some]] > 0)])
    # open windows: a span may lie in it, or reach into it from the one before
    way_out = gains(np.zeros((1, TAGS, 1), dtype=np.float32), trans)[2]
    is_open, text_of = inner + way_out > 0, np.array([w[0] for w in windows])
    meets = text_of[1:] == text_of[:-1]
    last = -1
    for w in np.flatnonzero(meets & (tail[:-1] + head[1:] + way_out > 0)).tolist():
        if w < last:
            continue
        carry, last = float(tail[w]), w
        while last < len(meets) and meets[last] and carry + head[last + 1] + way_out > 0:
            is_open[last] = is_open[last + 1] = True
            last += 1
            carry = max(float(tail[last]), carry + float(through[last]))
    lacking = np.array([w for w in by_length if is_open[w] and int(w) not in held], dtype=np.int64)
    for part, e in emitted(model, codes, windows, lacking):
        keep(part, e, np.arange(len(part)))
    stretches: list[list[int]] = []
    for w in np.flatnonzero(is_open).tolist():
        if stretches and stretches[-1][-1] == w - 1 and windows[w - 1][0] == windows[w][0]:
            stretches[-1].append(w)
        else:
            stretches.append([w])
    found: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    stretches.sort(key=len)
    at = 0
    while at < len(stretches):  # stretches of like length together
        end = at + 1
        while end < len(stretches) and len(stretches[end]) <= 1.5 * len(stretches[at]) and (end - at) * len(stretches[end]) < 512:
            end += 1
        parts = [np.concatenate([held[w] for w in s]) for s in stretches[at:end]]
        e = np.full((max(map(len, parts)) + 1, TAGS, len(parts)), -1e4, dtype=np.float32)  # behind each an O
        e[:, 0] = 0
        for column, p in enumerate(parts):
            e[: len(p), :, column] = p - p[:, :1]  # as gains over all O, which scores 0 then
        tags = viterbi(e, trans - trans[0, 0])
        for column, s in enumerate(stretches[at:end]):
            k, first = windows[s[0]][0], windows[s[0]][3]
            for a, b, kind in spans_of(tags[: len(parts[column]), column]):
                found[k].append((first + a, first + b, kind, gain(e[:, :, column], tags[:, column], trans, a, b)))
        at = end
    return [sorted(f) for f in found]


def gain(e: np.ndarray, tags: np.ndarray, trans: np.ndarray, a: int, b: int) -> float:
    """What the span of places a to b gains over no span, as if O stood on both sides."""
    path = np.concatenate([[0], tags[a:b].astype(np.intp), [0]])
    return float(e[np.arange(a, b), path[1:-1]].sum() + (trans[path[:-1], path[1:]] - trans[0, 0]).sum())


def spans_of(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """Spans of a tag sequence: a B and the I's of its kind that follow. An I without its B, where windows meet, begins one."""
    out = []
    at = np.flatnonzero(tags)
    k = 0
    while k < len(at):
        start = int(at[k])
        kind = (int(tags[start]) - 1) // 2
        end = start + 1
        while end < len(tags) and tags[end] == 2 + 2 * kind:
            end += 1
        out.append((start, end, KINDS[kind]))
        k = int(np.searchsorted(at, end))
    return out


def trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    while e > s and text[e - 1] in " \n\t,;.":
        e -= 1
    while s < e and text[s] in " \n\t":
        s += 1
    return s, e


def outside(s: int, e: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a span that no taken span, ordered by start, covers."""
    out = []
    for a, b in taken:
        if b > s and a < e:
            if a > s:
                out.append((s, a))
            s = max(s, b)
    return [*out, (s, e)] if s < e else out


def find(texts: list[str], model: Model) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text. Of a network span that meets base spans, the parts outside them are added: all that hold a
    letter or digit if the whole span passes its check, else those that pass it alone. Added spans overlap no base span."""
    out = []
    for text, more in zip(texts, network_spans(model, texts), strict=True):
        base = base_spans(text)
        taken = [(s, e) for s, e, _ in base]
        added = []
        for s, e, kind in more:
            s, e = trimmed(text, s, e)
            if kind == "phone" and plausible(text[s:e], "card"):
                kind = "card"
            whole = plausible(text[s:e], kind)
            for a, b in outside(s, e, taken):
                a, b = trimmed(text, a, b)
                if (whole and any(c.isalnum() for c in text[a:b])) or (not whole and (a, b) != (s, e) and plausible(text[a:b], kind)):
                    added.append((a, b, kind))
        out.append((base, sorted(base + added, key=lambda x: (x[0], KINDS.index(x[2])))))
    return out


# --- training -------------------------------------------------------------------------------------------------------------------


def _pick(r, letters: str, n: int) -> str:
    return "".join(letters[i] for i in r.integers(0, len(letters), n))


def made(r: np.random.Generator, kind: str) -> str:
    """A made piece of personal data, in spellings that the patterns have and others."""
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    if kind == "email":
        at, dot = [("@", "."), ("@", "."), (" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]")][r.integers(5)]
        return f"{_pick(r, low, r.integers(2, 9))}{['.', '_', ''][r.integers(3)]}{_pick(r, low + dig, r.integers(1, 5))}{at}{_pick(r, low + dig, r.integers(3, 8))}{dot}{['com', 'org', 'net', 'example'][r.integers(4)]}"
    if kind == "ip":
        return [".", ".", "[.]"][r.integers(3)].join(str(x) for x in r.integers(0, 256, 4))
    if kind == "card":
        digits = _pick(r, dig, 15)
        digits += next(d for d in dig if luhn(digits + d))
        sep = ["", "", " ", "-", "."][r.integers(5)]
        return sep.join(digits[k : k + 4] for k in (0, 4, 8, 12))
    if kind == "phone":
        a, b, c = _pick(r, "23456789", 3), _pick(r, dig, 3), _pick(r, dig, 4)
        return [f"+1 ({a}) {b}-{c}", f"+{r.integers(20, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1-{a}-{b}-{c}"][r.integers(5)]
    name = ["token", "password", "secret", "api_key", "passwd", "key"][r.integers(6)]
    value = _pick(r, ["0123456789abcdef", low + dig, low + up + dig][r.integers(3)], r.integers(12, 41))
    return ["AKIA" + _pick(r, up + dig, 16), f'{name} = "{value}"', f"{name}={value}", f"{name}: {value}"][r.integers(4)]


def look_alike(r: np.random.Generator) -> str:
    low, dig = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    return [
        _pick(r, dig, r.integers(1, 9)), f"{r.integers(1, 20)}.{r.integers(0, 10)}", f"{r.integers(1, 20)}.{r.integers(0, 10)}.{r.integers(0, 99)}", f"{r.integers(1900, 2030)}-{r.integers(1, 13):02d}-{r.integers(1, 29):02d}",
        _pick(r, dig, r.integers(20, 30)), f"@{_pick(r, 'abcdefgh', 5)}", f"{r.integers(1, 24)}:{r.integers(10, 60)}", f"+{r.integers(1, 99)}", f"${r.integers(1, 9999)}", "the token of", "a password is", "key to", "word***", "| a |", "ALL!! CAPS!!", f"version {r.integers(1, 9)}.0",
        " ".join([["at", "dot", "token", "key", _pick(r, low, r.integers(2, 10))][r.integers(5)]] * int(r.integers(3, 16))), " ".join(_pick(r, low.upper(), r.integers(2, 9)) for _ in range(r.integers(1, 5))), " ".join(_pick(r, "etaoinshr", r.integers(2, 12)) for _ in range(r.integers(1, 5))).capitalize(),
    ][r.integers(19)]


def windows(r: np.random.Generator, texts: list[str], n: int, personal: float = 0.7) -> tuple[np.ndarray, np.ndarray]:
    """n training windows (T, n) of classes, and their tags. personal: how much of what is written into them is personal data."""
    x, y = np.zeros((TRAIN_WINDOW, n), dtype=np.intp), np.zeros((TRAIN_WINDOW, n), dtype=np.int8)
    for k in range(n):
        text = texts[r.integers(len(texts))]
        at = int(r.integers(0, max(1, len(text) - TRAIN_WINDOW)))
        piece, parts = text[at : at + TRAIN_WINDOW], []
        for _ in range([0, 1, 1, 1, 1, 1, 2, 2, 3][r.integers(9)]):
            what = KINDS[r.integers(len(KINDS))] if r.random() < personal else None
            parts.append((made(r, what) if what else look_alike(r), what, ["", "", ",", ".", "###", "***"][r.integers(6)] + " "))
        blanks = [i + 1 for i, c in enumerate(piece[: max(1, TRAIN_WINDOW - sum(len(p) + 2 for p, _, _ in parts))]) if c == " "] or [0]
        put = blanks[r.integers(len(blanks))]
        extra, spans = "", []
        for part, what, end in parts:
            if what:
                spans.append((put + len(extra), put + len(extra) + len(part), what))
            extra += part + end
        piece = piece[:put] + extra + piece[put:]
        piece = piece[:TRAIN_WINDOW]
        spans += [s for s in base_spans(piece) if all(s[1] <= a or s[0] >= b for a, b, _ in spans)]
        for a, b, what in spans:
            y[a:b, k] = 2 + 2 * KINDS.index(what)
            y[a : a + 1, k] = 1 + 2 * KINDS.index(what)
        c = classes(piece)
        x[: len(c), k] = c
    return x, y


def _crf(e: np.ndarray, trans: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the mean negative log-likelihood by emissions (T, B, TAGS) and transitions, from scaled forward-backward."""
    steps, size, _ = e.shape
    w, m = np.exp(trans), np.exp(e - e.max(axis=2, keepdims=True))
    a, b, scale = np.empty_like(e), np.empty_like(e), np.empty((steps, size, 1))
    last = np.zeros((size, TAGS))
    last[:, 0] = 1
    start = last
    for s in range(steps):
        last = (last @ w) * m[s]
        scale[s] = last.sum(axis=1, keepdims=True)
        last = last / scale[s]
        a[s] = last
    b[-1] = 1
    for s in range(steps - 1, 0, -1):
        b[s - 1] = ((b[s] * m[s]) @ w.T) / scale[s]
    de = a * b
    de /= de.sum(axis=2, keepdims=True)
    before = np.concatenate([start[None], a[:-1]]).reshape(-1, TAGS)
    dt = w * (before.T @ (b * m / scale).reshape(-1, TAGS))
    np.put_along_axis(de, y[:, :, None].astype(np.intp), np.take_along_axis(de, y[:, :, None].astype(np.intp), axis=2) - 1, axis=2)
    earlier = np.concatenate([np.zeros((1, size), dtype=np.intp), y[:-1].astype(np.intp)])
    np.subtract.at(dt, (earlier.ravel(), y.ravel().astype(np.intp)), 1)
    return de / size, dt / size


def _forward(table, recur, x):
    steps, size = x.shape
    h = c = np.zeros((size, HIDDEN))
    kept = []
    for s in range(steps):
        z = table[x[s]] + h @ recur
        g = np.clip(z, 0, 1)
        i, f, o, n = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN : 3 * HIDDEN], 2 * g[:, 3 * HIDDEN :] - 1
        before, c_before = h, c
        c = f * c + i * n
        d = 1 / (1 + np.abs(c))
        h = o * c * d
        kept.append((before, c_before, i, f, o, n, c, d, (z > -0.25) & (z < 1.25)))
    return kept


def _backward(recur, kept, dh_all, x):
    dh = dc = np.zeros_like(kept[0][0])
    d_recur, dz_all = np.zeros_like(recur), np.empty((len(kept), len(dh), 4 * HIDDEN))
    for s in range(len(kept) - 1, -1, -1):
        before, c_before, i, f, o, n, c, d, inside = kept[s]
        dh = dh + dh_all[s]
        dc = dc + dh * o * d * d
        dz = np.concatenate([dc * n, dc * c_before, dh * c * d, 2 * dc * i], axis=1) * inside
        d_recur += before.T @ dz
        dz_all[s] = dz
        dh, dc = dz @ recur.T, dc * f
    one = np.zeros((x.size, CLASSES))
    one[np.arange(x.size), x.ravel()] = 1
    return one.T @ dz_all.reshape(x.size, -1), d_recur


def train(texts: list[str], steps: int = TRAIN_STEPS, rate: float = 0.02, seed: int = 8) -> Model:
    r = np.random.default_rng(seed)
    if not any(texts):
        texts = [" ".join(_pick(r, "etaoinshrdlu", int(r.integers(1, 9))) for _ in range(400))]
    texts = [t for t in texts if t]
    p = {f"inputs{k}": r.normal(0, 0.15, (CLASSES, 4 * HIDDEN)) for k in (0, 1)} | {f"recur{k}": r.normal(0, 0.12, (HIDDEN, 4 * HIDDEN)) for k in (0, 1)}
    for k in (0, 1):
        p[f"inputs{k}"] += np.repeat([0.5, 0.8, 0.5, 0.5], HIDDEN)
        p[f"inputs{k}"][0, : 2 * HIDDEN] = -10  # padding: input and forget gates stay shut
    p |= {"emit": r.normal(0, 0.5, (2 * HIDDEN, TAGS)), "bias": np.array([2.0] + [0.0] * (TAGS - 1)), "trans": r.normal(0, 0.1, (TAGS, TAGS))}
    allowed = _allowed()
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        x, y = windows(r, texts, TRAIN_BATCH)
        kept = [_forward(p[f"inputs{k}"], p[f"recur{k}"], x if k == 0 else x[::-1]) for k in (0, 1)]
        h = [np.stack([o * c * d for _, _, _, _, o, _, c, d, _ in kept[k]]) for k in (0, 1)]
        h = np.concatenate([h[0], h[1][::-1]], axis=2)
        de, dt = _crf(h @ p["emit"] + p["bias"], np.where(allowed, p["trans"], -1e4), y)
        dh = de @ p["emit"].T
        g = {"emit": h.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS), "bias": de.sum(axis=(0, 1)), "trans": dt * allowed}
        g["inputs0"], g["recur0"] = _backward(p["recur0"], kept[0], dh[:, :, :HIDDEN], x)
        g["inputs1"], g["recur1"] = _backward(p["recur1"], kept[1], dh[::-1, :, HIDDEN:], x[::-1])
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        for k, a in g.items():
            a = a * min(1.0, 5 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a * a
            p[k] -= rate * (1 - 0.9 * step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    model = Model([p["inputs0"], p["inputs1"]], [p["recur0"], p["recur1"]], p["emit"], p["bias"], p["trans"], allowed)
    model.margins = margins(model, *windows(r, texts, NEGATIVES, personal=0.0))
    return model


def margins(model: Model, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each kind the gain that one in 400 of the windows x has in a span where y has none; cards, phones and IP addresses are checked
    by other means and need none."""
    e, trans = emissions(model, x), transitions(model)
    e -= e[:, :1]
    tags, over = viterbi(e, trans - trans[0, 0]), [[] for _ in KINDS]
    for column in np.flatnonzero(tags.any(axis=0)):
        for a, b, kind in spans_of(tags[:, column]):
            if not y[a:b, column].any():
                over[KINDS.index(kind)].append(gain(e[:, :, column], tags[:, column], trans, a, b))
    rank = x.shape[1] // 400
    return np.array([sorted(v)[-1 - rank] if len(v) > rank and k in ("email", "secret") else 0.0 for k, v in zip(KINDS, over, strict=True)])


def fit(documents: DataFrame, train_texts: int = TRAIN_TEXTS, train_chars: int = TRAIN_CHARS) -> Model:
    """Learn from excerpts of at most train_chars characters of train_texts documents, those of smallest doc_id hash."""
    known = documents.where("doc_id IS NOT NULL AND text IS NOT NULL")
    chosen = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_texts)  # ids alone go to one place
    rows = known.join(F.broadcast(chosen), "doc_id").select("doc_id", F.substring("text", 1, train_chars).alias("text")).groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    return train([r["text"] for r in sorted(rows, key=lambda r: r["doc_id"])])


# --- over documents -------------------------------------------------------------------------------------------------------------


SPAN = "struct<start:long,end:long,kind:string>"


def scan(documents: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, base and spans, arrays of (start, end, kind) in code points, ordered by start and kind."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    shape = pa.schema([("doc_id", pa.int64()), ("base", span), ("spans", span)])
    keys = ("start", "end", "kind")

    def run(batches):
        for part in common.parts(batches, 1, PART_BYTES):
            found = find(part.column(1).to_pylist(), shared.value)
            columns = [pa.array([[dict(zip(keys, s, strict=True)) for s in row[k]] for row in found], span) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=shape)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id long, base array<{SPAN}>, spans array<{SPAN}>")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or run of overlapping spans, as <KIND> of the first of them."""
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, model: Model) -> DataFrame:
    """The documents, all columns, with personal data in text masked; n_chars, where there is one, follows the new text."""
    shared, schema = documents.sparkSession.sparkContext.broadcast(model), documents.schema
    at, count = documents.columns.index("text"), documents.columns.index("n_chars") if "n_chars" in documents.columns else None

    def run(batches):
        for batch in common.parts(batches, at, PART_BYTES):
            texts = batch.column(at).to_pylist()
            full = [t or "" for t in texts]
            new = [masked(t, spans) for t, (_, spans) in zip(full, find(full, shared.value), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array([n if t is not None else None for t, n in zip(texts, new, strict=True)], batch.schema.field(at).type)
            if count is not None:
                old = batch.column(count).to_pylist()
                columns[count] = pa.array([len(n) if t is not None and n != t else c for t, n, c in zip(texts, new, old, strict=True)], batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return documents.mapInArrow(run, schema)
