"""Personal data in texts: rules, and a character tagger that adds what the rules miss.

The rules find e-mail addresses, IP addresses, card and phone numbers. The tagger is a
bidirectional LSTM over characters with a CRF over its tags, trained in numpy (`Tagger`). It learns from
labelled spans: those of the rules in a bounded sample of windows, and the same windows with a
span rewritten in a form people also use (`variants`, and `lengthened` for long addresses). Spans of the tagger are added where they
touch no span of the rules and have the digits or the `@` of their kind. An added address reaches to
the ends that the rule would give it around its sign, however long its parts are.

Every kind has a digit or an `@`, so the tagger reads windows around those characters, wherever in
the text they are; around an `@` they reach to the ends of the neighbouring words. An address spelled
out without a sign (`jane at example dot com`) is not looked for. Windows overlap by half. Each is
decoded on its own, each character takes its tag from the window in which it stands farthest from
an edge, and the spans are then read from the whole text's tags, so a span that crosses windows is one.

Defined results: a null or empty text has no spans; spans count code points, end exclusive, and
are ordered by kind (`KINDS`), then start; very long runs of one character are scanned once;
repeated rows are judged once each; without a sample to learn from the rules stand alone; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geovis.llm.common import arrow_schema, id_and_text, map_arrow, record, slices

KINDS = ["email", "ip", "card", "phone"]
Span = tuple[int, int, int]  # kind, start, end

SAMPLE_DOCUMENTS = 1500
SAMPLE_WINDOWS = 4000
WINDOW = 64
CONTEXT = 20
STEPS = 160
BATCH = 64

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]")
TRIGGER = re.compile("[0-9@]+")
SPACE = re.compile(r"\s")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each `@`: the local part reaches left to the last character that can't be in it,
    or to the end of the address before."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * d, 10)) for d in values[1::2])) % 10 == 0


def rule_spans(text: str) -> list[Span]:
    """Spans of the rules, by kind, then start."""
    if not TRIGGER.search(text):
        return []
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(DIGITS.findall(m.group())) <= 15]
    return out


def windows_of(text: str) -> list[tuple[int, int]]:
    """[start, end) of the windows around digits and `@`, in order. Around an `@` no word at the
    edge of the context is cut. Places closer than their context share a stretch; a longer stretch
    is cut into windows that overlap by half."""
    out: list[tuple[int, int]] = []
    stretch: list[int] = []
    for m in TRIGGER.finditer(text):
        start, end = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if "@" in m.group():
            least = stretch[1] if stretch else 0
            if not text[start].isspace():
                while start > least and not text[start - 1].isspace():
                    start -= 1
            if end > least and not text[end - 1].isspace():
                space = SPACE.search(text, end)
                end = space.start() if space else len(text)
        if stretch and start <= stretch[1]:
            stretch[1] = max(stretch[1], end)
        else:
            if stretch:
                out += cut_up(*stretch)
            stretch = [start, end]
    return out + (cut_up(*stretch) if stretch else [])


def cut_up(start: int, end: int) -> list[tuple[int, int]]:
    starts = range(start, max(start + 1, end - WINDOW // 2), WINDOW // 2)
    return [(s, min(end, s + WINDOW)) for s in starts]


CHARACTERS = {chr(c): k + 4 for k, c in enumerate(range(32, 127))}  # 0 padding, 1 letter, 2 space, 3 other
N_CHARACTERS = 4 + 95
N_TAGS = 1 + 2 * len(KINDS)  # outside; first and inner character of each kind


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character numbers, padded to the longest, and lengths."""
    get = CHARACTERS.get
    rows = [[get(c) or (1 if c.isalpha() else 2 if c.isspace() else 3) for c in t] for t in texts]
    lengths = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), max(1, lengths.max(initial=1))), np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out, lengths


def tags_of(length: int, spans: list[Span]) -> list[int]:
    out = [0] * length
    for kind, start, end in spans:
        out[start:end] = [1 + 2 * kind] + [2 + 2 * kind] * (end - start - 1)
    return out


def spans_of(tags: list[int] | np.ndarray, offset: int = 0) -> list[Span]:
    """A span is a first tag with the inner tags of its kind behind it; inner tags without a first
    one open a span too."""
    out: list[Span] = []
    open_kind, start = -1, 0
    for k, tag in enumerate([*tags, 0]):
        kind, first = (int(tag) - 1) // 2 if tag else -1, bool(tag % 2)
        if open_kind >= 0 and (kind != open_kind or first):
            out.append((open_kind, offset + start, offset + k))
            open_kind = -1
        if kind >= 0 and open_kind < 0:
            open_kind, start = kind, k
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Character embedding, an LSTM in each direction, a score per tag, and a linear-chain CRF."""

    def __init__(self, embedding: int = 16, hidden: int = 24, seed: int = 11, kind: type = np.float32) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        shapes = {"chars": (N_CHARACTERS, embedding), "out": (2 * hidden, N_TAGS), "out_bias": (N_TAGS,), "next": (N_TAGS, N_TAGS), "first": (N_TAGS,)}
        for d in ("ahead", "back"):
            shapes |= {f"{d}_in": (embedding, 4 * hidden), f"{d}_state": (hidden, 4 * hidden), f"{d}_bias": (4 * hidden,)}
        self.weights = {k: (rng.standard_normal(s) * (0.3 if k == "chars" else (1 / np.sqrt(s[0])) if len(s) > 1 and k != "next" else 0)).astype(kind) for k, s in shapes.items()}
        for d in ("ahead", "back"):
            self.weights[f"{d}_bias"][hidden : 2 * hidden] = 1  # remember at first

    def lstm(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States of one direction, time first; where the mask is off the state passes through."""
        h_size, w = self.hidden, self.weights
        fed = x @ w[f"{d}_in"] + w[f"{d}_bias"]
        h = c = np.zeros((x.shape[1], h_size), x.dtype)
        out, kept = np.empty((*x.shape[:2], h_size), x.dtype), [()] * len(x)
        for t in range(len(x)) if d == "ahead" else range(len(x) - 1, -1, -1):
            z = fed[t] + h @ w[f"{d}_state"]
            gates = sigmoid(z[:, : 3 * h_size])
            i, f, o, g = gates[:, :h_size], gates[:, h_size : 2 * h_size], gates[:, 2 * h_size :], np.tanh(z[:, 3 * h_size :])
            m = mask[t][:, None]
            c_new = f * c + i * g
            tanh_c = np.tanh(c_new)
            kept[t] = (h, c, i, f, o, g, tanh_c, m)
            h, c = m * (o * tanh_c) + (1 - m) * h, m * c_new + (1 - m) * c
            out[t] = h
        return out, kept

    def scores(self, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Tag scores, time first, of padded character numbers."""
        w, kind = self.weights, self.weights["out"].dtype
        mask = (np.arange(x.shape[1])[:, None] < lengths[None, :]).astype(kind)
        seen = w["chars"][x.T]
        ahead, kept_ahead = self.lstm(seen, mask, "ahead")
        back, kept_back = self.lstm(seen, mask, "back")
        both = np.concatenate([ahead, back], axis=2)
        return both @ w["out"] + w["out_bias"], (x, seen, mask, both, kept_ahead, kept_back)

    def loss(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags y (time first), and its gradient."""
        w = self.weights
        s, held = self.scores(x, lengths)
        mask = held[2]
        steps, n = s.shape[:2]
        alpha = np.empty_like(s)
        alpha[0] = s[0] + w["first"]
        for t in range(1, steps):
            moved = log_sum(alpha[t - 1][:, :, None] + w["next"][None], 1) + s[t]
            alpha[t] = np.where(mask[t][:, None] > 0, moved, alpha[t - 1])
        total = log_sum(alpha[-1], 1)
        beta = np.zeros_like(s)
        for t in range(steps - 2, -1, -1):
            moved = log_sum(w["next"][None] + (s[t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(mask[t + 1][:, None] > 0, moved, 0)
        rows = np.arange(n)
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        d_s = np.exp(alpha + beta - total[None, :, None]) * mask[:, :, None]
        gold = w["first"][y[0]] + s[0, rows, y[0]]
        np.add.at(grad["first"], y[0], -1)
        grad["first"] += d_s[0].sum(axis=0)
        for t in range(steps):
            d_s[t, rows, y[t]] -= mask[t]
            if t:
                gold = gold + mask[t] * (s[t, rows, y[t]] + w["next"][y[t - 1], y[t]])
                pair = alpha[t - 1][:, :, None] + w["next"][None] + (s[t] + beta[t])[:, None, :] - total[:, None, None]
                grad["next"] += (np.exp(pair) * mask[t][:, None, None]).sum(axis=0)
                np.add.at(grad["next"], (y[t - 1], y[t]), -mask[t])
        self.backward(d_s, held, grad)
        return float((total - gold).mean()), {k: v / n for k, v in grad.items()}

    def backward(self, d_s: np.ndarray, held: tuple, grad: dict[str, np.ndarray]) -> None:
        w, h_size = self.weights, self.hidden
        x, seen, mask, both, kept_ahead, kept_back = held
        grad["out"] += np.einsum("tbh,tbk->hk", both, d_s)
        grad["out_bias"] += d_s.sum(axis=(0, 1))
        d_both = d_s @ w["out"].T
        d_seen = np.zeros_like(seen)
        for d, kept, d_h_all in (("ahead", kept_ahead, d_both[:, :, :h_size]), ("back", kept_back, d_both[:, :, h_size:])):
            d_h = d_c = np.zeros_like(d_h_all[0])
            d_z = np.empty((*d_h_all.shape[:2], 4 * h_size), d_h_all.dtype)
            for t in range(len(seen) - 1, -1, -1) if d == "ahead" else range(len(seen)):
                h, c, i, f, o, g, tanh_c, m = kept[t]
                d_h = d_h + d_h_all[t]
                new_h, new_c = m * d_h, m * d_c
                new_c = new_c + new_h * o * (1 - tanh_c**2)
                d_z[t] = np.concatenate([new_c * g * i * (1 - i), new_c * c * f * (1 - f), new_h * tanh_c * o * (1 - o), new_c * i * (1 - g**2)], axis=1)
                d_h = d_z[t] @ w[f"{d}_state"].T + (1 - m) * d_h
                d_c = new_c * f + (1 - m) * d_c
                grad[f"{d}_state"] += h.T @ d_z[t]
            grad[f"{d}_in"] += np.einsum("tbe,tbz->ez", seen, d_z)
            grad[f"{d}_bias"] += d_z.sum(axis=(0, 1))
            d_seen += d_z @ w[f"{d}_in"].T
        np.add.at(grad["chars"], x.T, d_seen * mask[:, :, None])

    def train(self, texts: list[str], spans: list[list[Span]], steps: int = STEPS, seed: int = 5) -> list[float]:
        """Adam over random batches; returns the losses."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        losses = []
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(texts), BATCH)
            x, lengths = coded([texts[k] for k in pick])
            y = np.zeros((x.shape[1], len(pick)), np.int64)
            for b, k in enumerate(pick):
                y[: len(texts[k]), b] = tags_of(len(texts[k]), spans[k])
            loss, grad = self.loss(x, lengths, y)
            losses.append(loss)
            size = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            rate = 0.02 * min(1.0, 4 * (1 - step / (steps + 1))) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grad.items():
                g = g * min(1.0, 5 / (size + 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                self.weights[k] = (self.weights[k] - rate * mean[k] / (np.sqrt(square[k]) + 1e-8)).astype(self.weights[k].dtype)
        return losses

    def decode(self, texts: list[str]) -> list[np.ndarray]:
        """The best tags of each text."""
        x, lengths = coded(texts)
        s, (_, _, mask, *_) = self.scores(x, lengths)
        steps, n = s.shape[:2]
        best = s[0] + self.weights["first"]
        came = np.zeros((steps, n, N_TAGS), np.int64)
        for t in range(1, steps):
            moved = best[:, :, None] + self.weights["next"][None]
            on = mask[t][:, None] > 0
            came[t] = np.where(on, moved.argmax(axis=1), np.arange(N_TAGS)[None])
            best = np.where(on, moved.max(axis=1) + s[t], best)
        tags = np.zeros((steps, n), np.int64)
        tags[-1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = came[t][np.arange(n), tags[t]]
        return [tags[:k, b] for b, k in enumerate(lengths)]


def variants(text: str, span: Span, rng: np.random.Generator) -> tuple[str, list[Span]] | None:
    """The window with its span in another common form."""
    kind, start, end = span
    body = text[start:end]
    digits = "".join(DIGITS.findall(body))
    if KINDS[kind] == "phone" and len(digits) == 11:
        area, mid, last = digits[1:4], digits[4:7], digits[7:]
        body = [f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}", f"00{digits[0]} {area} {mid} {last}"][int(rng.integers(4))]
    elif KINDS[kind] == "card":
        sep = " -./"[int(rng.integers(4))]
        body = sep.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    elif KINDS[kind] == "email":
        body = body.replace("@", [" @ ", "[@]", "(@)"][int(rng.integers(3))])
    else:
        return None
    return text[:start] + body + text[end:], [(kind, start, start + len(body))]


def lengthened(text: str, span: Span, rng: np.random.Generator) -> tuple[str, list[Span]]:
    """A window around the sign of an address in an added form with long parts, which the window's
    ends may cut."""
    kind, start, end = span
    local, _, host = text[start:end].partition("@")
    words = re.findall("[A-Za-z]{2,}", text) or ["x"]
    more = lambda marks: "".join(words[int(rng.integers(len(words)))] + marks[int(rng.integers(len(marks)))] for _ in range(int(rng.integers(1, 8))))
    local, host = more("._-") + local, more(".-") + host
    sign = [" @ ", "[@]", "(@)"][int(rng.integers(3))]
    at, stop = start + len(local), start + len(local) + len(sign) + len(host)
    text = text[:start] + local + sign + host + text[end:]
    first = max(0, min(len(text) - WINDOW, at - int(rng.integers(16, 48))))
    return text[first : first + WINDOW], [(kind, max(0, start - first), min(stop - first, WINDOW))]


def whole_address(text: str, span: Span, least: int) -> Span:
    """An e-mail span that has its sign and some of both parts, out to the ends of these parts, but
    not to before `least`; any other span as it is."""
    kind, start, end = span
    at = text.find("@", start, end) if KINDS[kind] == "email" else -1
    if at < 0:
        return span
    left, right = at, at + 1
    left -= text[left - 1 : left] in ("(", "[")
    left -= text[left - 1 : left] == " "
    right += text[right : right + 1] in (")", "]")
    right += text[right : right + 1] == " "
    if not start < left < right < end:
        return span
    while left > least and text[left - 1] in LOCAL:
        left -= 1
    host = DOMAIN.match(text, right)
    return kind, min(start, left), max(end, host.end()) if host else end


def plausible(text: str, span: Span) -> bool:
    """A span of the tagger has what its kind can't do without, and white space at no end. A number
    that fails the test of its kind (Luhn's of a card, parts of an address up to 255) is none."""
    kind, start, end = span
    body = text[start:end]
    digits = len(DIGITS.findall(body))
    if body != body.strip():
        return False
    alone = not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())
    if KINDS[kind] == "email":
        tight = re.sub(r" ?[\[(]?@[\])]? ?", "@", body)
        return "@" in tight and "." in tight.partition("@")[2] and not re.search(r"\s", tight) and alone
    letters = any(c.isalpha() for c in body)
    least, most = {"ip": (4, 12), "card": (16, 19), "phone": (9, 15)}[KINDS[kind]]
    if KINDS[kind] == "card" and not luhn("".join(c for c in body if "0" <= c <= "9")):
        return False
    if KINDS[kind] == "ip" and any(int(part) > 255 for part in re.findall("[0-9]+", body)):
        return False
    return not letters and least <= digits <= most and alone


def fit(docs: DataFrame) -> Tagger | None:
    """Train on the windows of SAMPLE_DOCUMENTS documents that have a digit or `@`, those whose id
    has the smallest hash, of which at most SAMPLE_WINDOWS windows come to the driver."""
    rows = id_and_text(docs).filter(F.col("text").rlike("[0-9@]"))
    few = rows.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS)
    schema = arrow_schema(window=pa.string(), spans=pa.list_(pa.int64()))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            texts, labels = [], []
            for text in batch.column(1).to_pylist():
                spans = rule_spans(text)
                for a, b in windows_of(text):
                    inside = [x for x in spans if a <= x[1] and x[2] <= b]
                    if all(x in inside for x in spans if x[1] < b and x[2] > a):
                        texts.append(text[a:b])
                        labels.append([v for k, s, e in apart(inside) for v in (k, s - a, e - a)])
            if texts:
                yield record(schema, texts, labels)

    labelled = map_arrow(rows.join(F.broadcast(few.distinct()), "doc_id", "left_semi"), label, "window string, spans array<long>")
    sample = labelled.orderBy(F.xxhash64("window"), "window").limit(SAMPLE_WINDOWS).collect()
    texts, spans = [], []
    rng, long_rng = np.random.default_rng(3), np.random.default_rng(4)
    for row in sample:
        own = [tuple(row["spans"][k : k + 3]) for k in range(0, len(row["spans"]), 3)]
        texts.append(row["window"])
        spans.append(own)
        other = variants(row["window"], own[0], rng) if len(own) == 1 else None
        if other:
            texts.append(other[0])
            spans.append(other[1])
        if len(own) == 1 and KINDS[own[0][0]] == "email":
            window, cut = lengthened(row["window"], own[0], long_rng)
            texts.append(window)
            spans.append(cut)
    if not any(spans):
        return None
    tagger = Tagger()
    tagger.train(texts, spans)
    return tagger


def apart(spans: list[Span]) -> list[Span]:
    """The spans without those that overlap an earlier one, by start."""
    out: list[Span] = []
    for span in sorted(spans, key=lambda x: (x[1], x[0])):
        if not out or span[1] >= out[-1][2]:
            out.append(span)
    return out


def added_spans(texts: list[str], rules: list[list[Span]], tagger: Tagger) -> list[list[Span]]:
    """Per text, the tagger's spans that touch none of the rules' spans."""
    places = [(k, a, b) for k, text in enumerate(texts) for a, b in windows_of(text)]
    decoded: list[np.ndarray] = []
    for at in range(0, len(places), 512):
        decoded += tagger.decode([texts[k][a:b] for k, a, b in places[at : at + 512]])
    out: list[list[Span]] = [[] for _ in texts]
    at = 0
    while at < len(places):
        k, start, end = places[at]
        stop = at + 1  # windows of one stretch overlap
        while stop < len(places) and places[stop][0] == k and places[stop][1] < end:
            end = places[stop][2]
            stop += 1
        tags, depth = np.zeros(end - start, np.int64), np.full(end - start, -1)
        for (_, a, b), own in zip(places[at:stop], decoded[at:stop], strict=True):
            inside = np.minimum(np.arange(b - a), np.arange(b - a)[::-1])
            better = np.flatnonzero(inside > depth[a - start : b - start])
            tags[a - start + better], depth[a - start + better] = own[better], inside[better]
        out[k] += spans_of(tags, start)
        at = stop
    for k, spans in enumerate(out):
        kept: list[Span] = []
        for span in spans:
            least = kept[-1][2] if kept else 0
            for x in dict.fromkeys((whole_address(texts[k], span, least), span)):
                if plausible(texts[k], x) and not any(x[1] < e and s < x[2] for _, s, e in rules[k]):
                    if x[2] > least:  # else it is a part of the address before
                        kept.append(x)
                    break
        out[k] = kept
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """doc_id, spans of the rules and of both, as arrays of (kind, start, end)."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = arrow_schema(doc_id=pa.int64(), base=span, spans=span, base_text=pa.string(), spans_text=pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            texts = batch.column(1).to_pylist()
            base = [rule_spans(t) for t in texts]
            more = added_spans(texts, base, tagger) if tagger else [[] for _ in texts]
            both = [sorted(a + b) for a, b in zip(base, more, strict=True)]
            named = lambda rows: [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in row] for row in rows]
            yield record(schema, batch.column(0), named(base), named(both), [written(x) for x in base], [written(x) for x in both])

    spans = "array<struct<kind:string,start:long,end:long>>"
    return map_arrow(id_and_text(docs), run, f"doc_id long, base {spans}, spans {spans}, base_text string, spans_text string")


def masked(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """The columns of `docs` with every span of the text replaced by its kind in brackets. A null
    text stays null."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            texts = batch.column(at).to_pylist()
            whole = [t or "" for t in texts]
            base = [rule_spans(t) for t in whole]
            more = added_spans(whole, base, tagger) if tagger else [[] for _ in whole]
            out = [t and hidden(t, a + b) for t, a, b in zip(texts, base, more, strict=True)]
            columns = [pa.array(out, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_arrow(docs, run, docs.schema)


def hidden(text: str, spans: list[Span]) -> str:
    """The text with its spans, joined where they overlap, replaced by the kind of the first."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
