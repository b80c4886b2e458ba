"""Personal data: fixed patterns, and a bidirectional LSTM with CRF transitions over characters.

The network is trained here in numpy from labelled spans: what the patterns find in a bounded sample
of documents, part of it rewritten in forms that the patterns miss. It reads windows of a text
around digits, `@` and `at` in brackets. Windows overlap; each is decoded to the probabilities of
its characters' tags, these are averaged over windows, those near a window's edge weighing less, and
the best legal sequence of tags is found over each whole stretch of windows. Spans of the patterns
stay; the network adds spans that overlap none of them and hold up as data of their kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import slices, texts, written

#: Kinds in the order that breaks ties.
KINDS = ("email", "ip", "card", "phone")
#: Tags: 0 outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
WINDOW, STRIDE, CONTEXT = 96, 48, 32
#: Windows that are read at once.
BATCH = 256
EMBEDDING, HIDDEN = 16, 24
#: Documents (expected number) that samples come from, and the most windows of each kind, and without any, that are learned from.
LEARN_DOCS, LEARN_WINDOWS = 20_000, 200
EPOCHS, LEARN_BATCH, RATE = 9, 50, 0.012
#: Times that a sampled span is written anew.
REWRITTEN = 3
#: Mean probability of its tags that an added span must have.
LEAST = 0.8

_local = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_dotted = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_digits = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_trigger = re.compile(r"[0-9@]|[(\[]at[)\]]")
_space = re.compile(r"\s")

Span = tuple[int, int, int]  # start, rank of the kind, end


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(twice) + sum(map(int, digits[::-2]))) % 10 == 0


def _byte_sized(number: str) -> bool:
    own = number.lstrip("0")
    return len(own) <= 3 and int(own or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and non-overlapping per kind, those that fail their check dropped. Linear in the text."""
    found: list[Span] = []
    at, floor = text.find("@"), 0  # a local part begins after the last match and after the last @
    while at >= 0:
        start = floor + len(text[floor:at].rstrip(_local))
        match = _domain.match(text, at + 1) if start < at else None
        floor = at + 1
        if match:
            found.append((start, 0, match.end()))
            floor = match.end()
        at = text.find("@", floor)
    for run in _dotted.finditer(text):
        parts, at = run.group().split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            own = parts[k : k + 4]
            end = at + sum(map(len, own)) + 3
            if all(map(_byte_sized, own)):
                found.append((at, 1, end))
            at = end + 1
    for run in _digits.finditer(text):
        digits = run.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((run.start(), 2, run.end()))
    for run in _phone.finditer(text):
        if 10 <= sum(c.isdigit() for c in run.group()) <= 15:
            found.append((run.start(), 3, run.end()))
    return sorted(found)


def line(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text that windows cover: the words that hold a trigger, with CONTEXT around them."""
    found: list[list[int]] = []
    end = 0
    for hit in _trigger.finditer(text):
        at = hit.start()
        if at < end:
            continue
        left = max(text.rfind(" ", end, at), text.rfind("\n", end, at), end - 1) + 1
        stop = _space.search(text, hit.end())
        end = stop.start() if stop else len(text)
        low, high = max(0, left - CONTEXT), min(len(text), end + CONTEXT)
        if found and low <= found[-1][1]:
            found[-1][1] = high
        else:
            found.append([low, high])
    return [(a, b) for a, b in found]


#: Printable ASCII has numbers of its own; 0 is beyond the text, 1 other letters, 2 other white space, 3 the rest.
SYMBOLS = 4 + 95


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where((codes >= 32) & (codes < 127), codes - 28, 0).astype(np.int64)
    for at in np.flatnonzero(out == 0):
        c = text[at]
        out[at] = 1 if c.isalpha() else 2 if c.isspace() else 3
    return out


def tags(spans: list[Span], start: int, size: int) -> np.ndarray:
    """Tags of the characters from start on; of spans that overlap, the first in order counts."""
    out = np.zeros(size, np.int64)
    for a, k, b in spans:
        low, high = max(a - start, 0), min(b - start, size)
        if low < high and not out[low:high].any():
            out[low:high] = 2 + 2 * k
            if a >= start:
                out[low] = 1 + 2 * k
    return out


#: Which tag may follow which: inside only after begin or inside of its kind.
LEGAL = np.array([[t == 0 or t % 2 == 1 or (s in (t - 1, t) and s > 0) for t in range(TAGS)] for s in range(TAGS)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Embedding, one LSTM in each direction, a linear layer and transitions between tags; all weights in one dictionary."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, hidden: int = HIDDEN, embedding: int = EMBEDDING, seed: int = 7):
        if weights is None:
            rng = np.random.default_rng(seed)
            normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
            weights = {
                "embedding": normal(SYMBOLS, embedding, scale=0.3),
                "input": normal(2, embedding, 4 * hidden, scale=embedding**-0.5),
                "recurrent": normal(2, hidden, 4 * hidden, scale=hidden**-0.5),
                "bias": np.zeros((2, 4 * hidden), np.float32),
                "output": normal(2, hidden, TAGS, scale=hidden**-0.5),
                "output_bias": np.zeros(TAGS, np.float32),
                "transitions": np.zeros((TAGS, TAGS), np.float32),
            }
            weights["bias"][:, hidden : 2 * hidden] = 1  # gates: in, forget, out, cell
        self.w = weights

    def _states(self, codes: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """Hidden states (characters, directions, windows, HIDDEN) of windows given as characters by windows; direction 1 is in reading order backwards."""
        w, size = self.w, self.w["recurrent"].shape[1]
        fed = np.matmul(w["embedding"], w["input"]) + w["bias"][:, None]  # what each symbol feeds, by direction
        steps, many = codes.shape
        h = c = np.zeros((2, many, size), w["input"].dtype)
        out, kept = np.empty((steps, 2, many, size), h.dtype), []
        for t in range(steps):
            z = np.matmul(h, w["recurrent"])
            z[0] += fed[0][codes[t]]
            z[1] += fed[1][codes[steps - 1 - t]]
            gates, cell = _sigmoid(z[..., : 3 * size]), np.tanh(z[..., 3 * size :])
            before, i, f, o = c, gates[..., :size], gates[..., size : 2 * size], gates[..., 2 * size :]
            c = f * before + i * cell
            own = np.tanh(c)
            if keep:
                kept.append((h, before, gates, cell, own))
            h = out[t] = o * own
        return out, kept

    def scores(self, states: np.ndarray) -> np.ndarray:
        """Scores of tags (characters, windows, TAGS)."""
        return np.matmul(states[:, 0], self.w["output"][0]) + np.matmul(states[::-1, 1], self.w["output"][1]) + self.w["output_bias"]

    def chain(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the CRF: probabilities of tags, the scaled forward and backward sums, and log of the normaliser (windows)."""
        steps, many, _ = scores.shape
        move = np.where(LEGAL, np.exp(self.w["transitions"]), 0)
        top = scores.max(2, keepdims=True)
        own = np.exp(scores - top)
        ahead, back = np.empty_like(own), np.empty_like(own)
        log = top.sum((0, 2))
        for t in range(steps):
            a = own[t] if t == 0 else np.matmul(ahead[t - 1], move) * own[t]
            total = a.sum(1, keepdims=True)
            ahead[t] = a / total
            log = log + np.log(total[:, 0])
        back[-1] = 1
        for t in range(steps - 2, -1, -1):
            b = np.matmul(back[t + 1] * own[t + 1], move.T)
            back[t] = b / b.sum(1, keepdims=True)
        both = ahead * back
        return both / both.sum(2, keepdims=True), ahead, back * own, log

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        return self.chain(self.scores(self._states(codes)[0]))[0]

    def loss(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags of windows, and its gradient by every weight."""
        w, size = self.w, self.w["recurrent"].shape[1]
        states, kept = self._states(codes, True)
        scores = self.scores(states)
        steps, many, _ = scores.shape
        p, ahead, after, log = self.chain(scores)
        move = np.where(LEGAL, np.exp(w["transitions"]), 0)
        took = np.take_along_axis(scores, labels[..., None], 2)[..., 0].sum(0) + w["transitions"][labels[:-1], labels[1:]].sum(0)
        g = {name: np.zeros_like(x) for name, x in w.items()}
        d_scores = p.copy()
        np.put_along_axis(d_scores, labels[..., None], np.take_along_axis(d_scores, labels[..., None], 2) - 1, 2)
        d_scores /= many
        pairs = ahead[:-1, :, :, None] * move * after[1:, :, None, :]
        g["transitions"] = (pairs / pairs.sum((2, 3), keepdims=True)).sum((0, 1))
        np.subtract.at(g["transitions"], (labels[:-1].ravel(), labels[1:].ravel()), 1)
        g["transitions"] = (g["transitions"] / many).astype(w["transitions"].dtype)
        g["output_bias"] = d_scores.sum((0, 1))
        by = np.stack([d_scores, d_scores[::-1]], 1)  # steps, directions, windows, tags
        flat = lambda x, d: np.ascontiguousarray(x[:, d]).reshape(steps * many, -1)
        g["output"] = np.stack([flat(states, d).T @ flat(by, d) for d in (0, 1)])
        d_states = np.matmul(by, w["output"].transpose(0, 2, 1)[None])
        d_read = np.empty((steps, 2, many, 4 * size), states.dtype)
        d_h, d_c = np.zeros_like(states[0]), np.zeros_like(states[0])
        for t in range(steps - 1, -1, -1):
            h, before, gates, cell, own = kept[t]
            i, f, o = gates[..., :size], gates[..., size : 2 * size], gates[..., 2 * size :]
            d_h = d_h + d_states[t]
            d_c = d_c + d_h * o * (1 - own * own)
            d_gates = np.concatenate([d_c * cell, d_c * before, d_h * own], 2) * gates * (1 - gates)
            d_z = d_read[t] = np.concatenate([d_gates, d_c * i * (1 - cell * cell)], 2)
            g["recurrent"] += np.matmul(h.transpose(0, 2, 1), d_z)
            d_h, d_c = np.matmul(d_z, w["recurrent"].transpose(0, 2, 1)), d_c * f
        which = np.zeros((steps * many, SYMBOLS), states.dtype)
        which[np.arange(steps * many), codes.ravel()] = 1
        d_fed = np.stack([which.T @ flat(d_read, 0), which.T @ flat(d_read[::-1], 1)])
        g["bias"] = d_fed.sum(1)
        g["input"] = np.matmul(w["embedding"].T[None], d_fed)
        g["embedding"] = np.matmul(d_fed, w["input"].transpose(0, 2, 1)).sum(0)
        return float((log - took).mean()), g

    def fit(self, codes: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> None:
        """Adam over shuffled batches of windows (windows by characters), gradients clipped, the rate falling to a tenth."""
        rng = np.random.default_rng(seed)
        first, second, step = {k: np.zeros_like(x) for k, x in self.w.items()}, {k: np.zeros_like(x) for k, x in self.w.items()}, 0
        batches = -(-len(codes) // LEARN_BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(codes))
            for start in range(0, len(codes), LEARN_BATCH):
                some = order[start : start + LEARN_BATCH]
                _, g = self.loss(codes[some].T, labels[some].T)
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                step += 1
                rate = RATE * 0.1 ** (step / (epochs * batches))
                for k, x in g.items():
                    x = x * min(1.0, 5.0 / (norm + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * x
                    second[k] = 0.99 * second[k] + 0.01 * x * x
                    self.w[k] = (self.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


#: Forms in which spans of each kind are written that the patterns miss (first) or take (second), from digits d, a name and a host.
def rewritten(kind: int, rng: np.random.Generator, name: str, host: str) -> str:
    """A made-up span of a kind, half of the time in a form that no pattern takes."""
    pick = lambda *options: options[int(rng.integers(len(options)))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    if kind == 0:
        name += pick("", "", f".{digits(2)}", f"_{name[:3]}", f"-{name[:2]}", digits(2))
        at, dot = pick(("@", "."), ("(at)", "."), ("[at]", "."), (" (at) ", "."), (" [at] ", " [dot] "), ("@", "[.]"))
        return f"{name}{at}{host}{dot}{pick('com', 'org', 'net', 'de', 'fr', 'example' + dot + 'com')}"
    if kind == 1:
        return pick(".", "[.]", "(.)", " . ").join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        size = int(rng.integers(14, 20)) if rng.random() < 0.3 else 16
        body = digits(size - 1)
        body += next(str(k) for k in range(10) if luhn(body + str(k)))
        sep = pick("", " ", "-", ".", "/", "\xa0", "  ")
        return sep.join(body[k : k + 4] for k in range(0, size, 4))
    area, a, b = digits(3), digits(3), digits(4)
    return pick(f"+{pick('1', '44', '49')} ({area}) {a}-{b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"+{pick('1', '33')} {area} {a} {b}", f"00{pick('1', '49')} {area} {a} {b}", f"({area}) {a} {b}")


def decoy(rng: np.random.Generator) -> str:
    """Numbers and signs that aren't personal data."""
    n = lambda low, high: int(rng.integers(low, high))
    options = (
        f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 29):02}", f"{n(0, 24):02}:{n(0, 60):02}:{n(0, 60):02}", f"{n(1, 31)}.{n(1, 13)}.{n(1900, 2100)}", f"v{n(0, 20)}.{n(0, 20)}.{n(0, 20)}",
        f"{n(1, 999)},{n(0, 1000):03}.{n(0, 100):02}", f"{n(0, 10**6)}", f"{n(0, 10**12)}", f"@{'abcdefgh'[: n(2, 9)]}", f"{n(1, 100)}%", f"#{n(1, 10**5)}", f"{n(1, 10)}.", f"{rng.bytes(n(8, 20)).hex()}", f"ISBN {n(100, 999)}-{n(0, 9)}-{n(10**4, 10**5)}",
    )
    return options[int(rng.integers(len(options)))]


def examples(samples: list[tuple[str, list[Span]]], seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags from sampled windows and their spans: each as it is; REWRITTEN times with one of its spans written anew; and with a decoy in place of a word."""
    rng = np.random.default_rng(seed)
    rows: list[tuple[str, list[Span]]] = []
    for text, spans in samples:
        rows.append((text, spans))
        names = re.findall(r"[a-z]{3,}", text.lower()) or ["name"]
        name, host = names[int(rng.integers(len(names)))], names[int(rng.integers(len(names)))]
        if spans:
            a, kind, b = spans[int(rng.integers(len(spans)))]
            for _ in range(REWRITTEN if a >= 0 and b <= len(text) and not any(x < b and a < y for x, k, y in spans if (x, k, y) != (a, kind, b)) else 0):
                made = rewritten(kind, rng, name, host)
                move = len(made) - (b - a)
                rows.append((text[:a] + made + text[b:], sorted([(x + move * (x >= b), k, y + move * (x >= b)) for x, k, y in spans if x != a] + [(a, kind, a + len(made))])))
        gaps = [m.start() for m in re.finditer(" ", text)]
        if gaps:
            at = gaps[int(rng.integers(len(gaps)))]
            if not any(x <= at < y for x, _, y in spans):
                made = f" {decoy(rng)}"
                rows.append((text[:at] + made + text[at:], [(x + len(made) * (x >= at), k, y + len(made) * (x >= at)) for x, k, y in spans]))
    codes, labels = np.zeros((len(rows), WINDOW), np.int64), np.zeros((len(rows), WINDOW), np.int64)
    for k, (text, spans) in enumerate(rows):
        own = symbols(text[:WINDOW])
        codes[k, : len(own)], labels[k, : len(own)] = own, tags(spans, 0, len(own))
    return codes, labels


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A window for each span of the patterns, and for each stretch without one: its kind (-1 for none), text and spans."""
    for part in slices(batches):
        kinds, windows, spans = [], [], []
        for text in texts(part.column("text")):
            found = base_spans(text)
            bare = [(a, b) for a, b in stretches(text) if not any(x < b and a < y for x, _, y in found)] if len(found) < 100 else []
            for a, k, b in [*found, *[(a, -1, b) for a, b in bare]]:
                room = max(WINDOW - (b - a), 0)
                start = max(0, min(a - int.from_bytes(hashlib.md5(f"{a}|{text[a:b]}".encode("utf-8", "surrogatepass")).digest()[:4], "big") % (room + 1), len(text) - WINDOW))
                kinds.append(k)
                windows.append(text[start : start + WINDOW])
                spans.append([n for x, j, y in found if x < start + WINDOW and start < y for n in (x - start, j, y - start)])
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(windows, pa.string()), pa.array(spans, pa.list_(pa.int32()))], ["kind", "window", "spans"])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn_docs: int = LEARN_DOCS, learn_windows: int = LEARN_WINDOWS, epochs: int = EPOCHS) -> Tagger:
    """A tagger from labelled spans of about learn_docs documents, chosen by a hash of the id: learn_windows windows of each kind at most, and of none.

    Documents without text teach nothing; without any spans the tagger finds nothing.
    """
    count = docs.count()
    at = F.pmod(F.xxhash64(F.col(id_col), F.lit("pii")), F.lit(1_000_003)) / 1_000_003.0
    rows = docs.filter(at < min(1.0, learn_docs / max(count, 1))).filter(F.length(text_col) > 0).select(F.col(text_col).alias("text"))
    found = written(rows.mapInArrow(_samples, "kind int, window string, spans array<int>").dropDuplicates(["window"]).withColumn("at", F.xxhash64("window", "kind")), "samples")
    taken: list[tuple[str, list[Span]]] = []
    for kind in range(-1, len(KINDS)):
        some = found.filter(F.col("kind") == kind).orderBy("at", "window").limit(learn_windows).collect()  # bounded by learn_windows
        taken += [(r["window"], [tuple(r["spans"][k : k + 3]) for k in range(0, len(r["spans"]), 3)]) for r in some]
    tagger = Tagger()
    if not any(spans for _, spans in taken):
        tagger.w["output"][:], tagger.w["output_bias"][1:] = 0, -20
        return tagger
    tagger.fit(*examples(taken), epochs)
    return tagger


class Finder:
    """Spans of many texts: windows of all texts are read in batches, each stretch is then decoded whole."""

    def __init__(self, tagger: Tagger, least: float = LEAST):
        self.tagger, self.least = tagger, least

    def added(self, many: list[str], base: list[list[Span]]) -> list[list[Span]]:
        parts = [(k, a, b) for k, text in enumerate(many) for a, b in stretches(text)]
        found: list[list[Span]] = [[] for _ in many]
        for (k, a, _), p in zip(parts, self._mean([many[k][a:b] for k, a, b in parts]), strict=True):
            found[k] += self._spans(many[k], a, p)
        return [self._apart(own, known) for own, known in zip(found, base, strict=True)]

    def _mean(self, parts: list[str]) -> Iterator[np.ndarray]:
        """Mean probabilities of tags of each stretch's characters, a window weighing by a character's distance from those edges at which the text goes on."""
        held: list[tuple[int, int, np.ndarray]] = []  # stretch, start in it, symbols
        sums = {}

        def read() -> None:
            codes = np.zeros((WINDOW, len(held)), np.int64)
            for k, (_, _, own) in enumerate(held):
                codes[: len(own), k] = own
            p = self.tagger.probabilities(codes)
            for k, (part, start, own) in enumerate(held):
                total, weights = sums[part]
                n = len(own)
                place = np.arange(n)
                left = place + 1 if start else np.full(n, WINDOW)
                right = n - place if start + n < len(total) else np.full(n, WINDOW)
                weight = np.minimum(left, right).astype(np.float32)
                total[start : start + n] += p[:n, k] * weight[:, None]
                weights[start : start + n] += weight
            held.clear()

        out = 0
        for k, text in enumerate(parts):
            own = symbols(text)
            sums[k] = np.zeros((len(own), TAGS), np.float32), np.zeros(len(own), np.float32)
            for start in range(0, max(len(own) - STRIDE, 1), STRIDE):
                held.append((k, start, own[start : start + WINDOW]))
                if len(held) == BATCH:
                    read()
                    while out < k:  # those before the present one are whole
                        total, weights = sums.pop(out)
                        yield total / weights[:, None]
                        out += 1
        if held:
            read()
        while out < len(parts):
            total, weights = sums.pop(out)
            yield total / weights[:, None]
            out += 1

    def _spans(self, text: str, start: int, p: np.ndarray) -> list[Span]:
        """Spans on the most probable legal sequence of tags that hold up as data of their kind."""
        if p[:, 0].min() > 0.5:  # then no span can be the most probable
            return []
        path = best_path(p)
        found = []
        begins = np.flatnonzero(path % 2 == 1)
        for a in begins:
            kind = (path[a] - 1) // 2
            b = a + 1
            while b < len(path) and path[b] == 2 + 2 * kind:
                b += 1
            own = text[start + a : start + b]
            low, high = start + a + len(own) - len(own.lstrip()), start + b - len(own) + len(own.rstrip())
            if low < high and p[np.arange(a, b), path[a:b]].mean() >= self.least and holds_up(int(kind), text, low, high):
                found.append((int(low), int(kind), int(high)))
        return found

    def _apart(self, found: list[Span], base: list[Span]) -> list[Span]:
        """Those that overlap no base span; both are in order of their starts."""
        kept, at, reached = [], 0, 0
        for a, k, b in found:
            while at < len(base) and base[at][0] < b:
                reached = max(reached, base[at][2])
                at += 1
            if reached <= a:
                kept.append((a, k, b))
        return kept


def best_path(p: np.ndarray) -> np.ndarray:
    """The legal sequence of tags whose product of probabilities is greatest; no inside tag at the beginning."""
    score = np.log(np.maximum(p, 1e-30))
    own = np.where([t == 0 or t % 2 == 1 for t in range(TAGS)], score[0], -np.inf)
    before = np.zeros((len(p), TAGS), np.int8)
    for t in range(1, len(p)):
        # outside and begin tags follow any tag, an inside tag its own kind's two
        top = int(own.argmax())
        step = np.full(TAGS, own[top])
        before[t] = top
        inside, begin = own[2::2], own[1::2]
        stays = inside >= begin
        step[2::2] = np.where(stays, inside, begin)
        before[t, 2::2] = np.where(stays, np.arange(2, TAGS, 2), np.arange(1, TAGS, 2))
        own = step + score[t]
    path = np.zeros(len(p), np.int64)
    path[-1] = own.argmax()
    for t in range(len(p) - 1, 0, -1):
        path[t - 1] = before[t, path[t]]
    return path


def holds_up(kind: int, text: str, a: int, b: int) -> bool:
    """Whether text[a:b], which goes on in no word or number, can be data of the kind: the patterns' own limits, whatever stands between digits."""
    if (a and text[a - 1].isalnum() and text[a].isalnum()) or (b < len(text) and text[b].isalnum() and text[b - 1].isalnum()):
        return False
    own = text[a:b]
    numbers = re.findall(r"[0-9]+", own)
    digits = "".join(numbers)
    if kind == 0:
        sides = re.split(r"\s?[(\[]at[)\]]\s?|@", own)
        return len(sides) == 2 and bool(re.search(r"[A-Za-z0-9]\Z", sides[0])) and bool(re.match(r"[A-Za-z0-9-]+(?:(?:\.|\s?[\[(](?:\.|dot)[\])]\s?)[A-Za-z0-9-]+)+\Z", sides[1]))
    if re.search(r"[A-Za-z]", own):
        return False
    if kind == 1:
        return len(numbers) == 4 and all(map(_byte_sized, numbers))
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15


def find(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_added, base_spans, spans of every row.

    Spans are kind:start:end, code points, end exclusive, by start, then kind as in KINDS, comma-joined:
    base_spans those of the patterns, which the four counts count, spans these and the n_added ones of
    the tagger. Null texts are empty: no spans. Repeated rows give repeated results; empty tables none.
    Columns of docs besides id and text are not read.
    """
    shared: Any = docs.sparkSession.sparkContext.broadcast(tagger.w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(Tagger(shared.value), least)
        for part in slices(batches):
            many = texts(part.column("text"))
            base = [base_spans(t) for t in many]
            added = finder.added(many, base)
            counts = [pa.array([sum(s[1] == k for s in own) for own in base], pa.int64()) for k in range(len(KINDS))]
            both = [line(sorted(x + y)) for x, y in zip(base, added, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, pa.array(map(len, added), pa.int64()), pa.array(map(line, base), pa.string()), pa.array(both, pa.string())], [*_FOUND])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in _FOUND.items()))


_FOUND = {"doc_id": "long", **{f"n_{k}": "long" for k in KINDS}, "n_added": "long", "base_spans": "string", "spans": "string"}
