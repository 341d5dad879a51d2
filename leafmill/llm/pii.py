"""Personal data by fixed rules and a character-level bidirectional LSTM with a CRF, trained in numpy."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .arrow_text import bounded_batches

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
TRAIN_ROWS, TRAIN_WINDOWS = 400, 2000
"""Most documents that training windows come from, the first by a hash of doc_id among those with a digit or an @; and most windows, the first by a hash of doc_id and place."""
WINDOW, STRIDE, REACH = 64, 32, 24
LEVELS, PRECISION = (0.6, 0.7, 0.8, 0.9, 0.95, 0.98), 0.98
"""Thresholds that are tried on held-out windows; the least one that is as precise as this is used, else the last."""

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a run of digits is tried once, at its start
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the rules' matches, leftmost and non-overlapping by kind, by start and kind.

    An email is looked for at each @, which is where a scan from the left
    would meet it: its local part is the run before the @ that no earlier
    match has used.
    """
    found = []
    at, used = text.find("@"), 0
    while at >= 0:
        start = at
        while start > used and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end(), 0))
            used = m.end()
        at = text.find("@", max(at + 1, used))
    for m in _IP.finditer(text):
        if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


_TRIGGER = re.compile(r"[0-9@]|[(\[]\s?(?:at|dot)\s?[)\]]")
_ALPHABET = {c: i + 1 for i, c in enumerate("0123456789@.-_%+ ()[]\n:/,#$=\"'")}
N_CODES = len(_ALPHABET) + 6


def encode(text: str) -> np.ndarray:
    """Symbol numbers: each sign of the alphabet its own, one for all other signs, and for letters by case and script."""
    n = len(_ALPHABET)
    return np.array([_ALPHABET.get(c) or (n + 1 if "a" <= c <= "z" else n + 2 if "A" <= c <= "Z" else n + 3 if c.isalpha() else n + 4) for c in text], np.int64)


def windows(text: str) -> list[tuple[int, int]]:
    """Overlapping windows over the zones around each digit, @, and "at" or "dot" in brackets; the tagger looks nowhere else."""
    zones: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if zones and a <= zones[-1][1]:
            zones[-1][1] = b
        else:
            zones.append([a, b])
    return [(s, min(s + WINDOW, b)) for a, b in zones for s in range(a, max(a + 1, b - WINDOW + STRIDE), STRIDE)]


class Tagger:
    """Embedding, one LSTM in each direction, a linear layer, and CRF transitions."""

    def __init__(self, embed: int = 12, hidden: int = 20, seed: int = 3):
        rng = np.random.default_rng(seed)
        k = len(TAGS)
        self.hidden, self.sure = hidden, LEVELS[-1]
        self.p = {"emb": rng.normal(0, 0.3, (N_CODES, embed)), "out": rng.normal(0, 0.2, (2 * hidden, k)), "bias": np.zeros(k), "trans": np.zeros((k, k))}
        for d in "fb":
            self.p[f"wx{d}"] = rng.normal(0, 1 / np.sqrt(embed), (embed, 4 * hidden))
            self.p[f"wh{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            self.p[f"b{d}"] = np.concatenate((np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)))

    def _lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """x is (time, batch, embed); gates in the order input, forget, cell, output."""
        n, h = self.hidden, np.zeros((x.shape[1], self.hidden))
        c, out, kept = h, np.empty((*x.shape[:2], n)), []
        drive = x @ self.p[f"wx{d}"] + self.p[f"b{d}"]
        for t in range(len(x)):
            g = drive[t] + h @ self.p[f"wh{d}"]
            s = 1 / (1 + np.exp(-g))
            i, f, o, u = s[:, :n], s[:, n : 2 * n], s[:, 3 * n :], np.tanh(g[:, 2 * n : 3 * n])
            before, last = c, h
            c = f * c + i * u
            tc = np.tanh(c)
            h = out[t] = o * tc
            kept.append((i, f, o, u, before, tc, last))
        return out, kept

    def _lstm_back(self, x: np.ndarray, kept: list, dout: np.ndarray, d: str, g: dict) -> np.ndarray:
        wx, wh = self.p[f"wx{d}"], self.p[f"wh{d}"]
        dh = dc = 0.0
        dx = np.empty_like(x)
        for t in range(len(x) - 1, -1, -1):
            i, f, o, u, before, tc, last = kept[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc * tc)
            dg = np.concatenate((dc * u * i * (1 - i), dc * before * f * (1 - f), dc * i * (1 - u * u), dh * tc * o * (1 - o)), axis=1)
            g[f"wx{d}"] += x[t].T @ dg
            g[f"wh{d}"] += last.T @ dg
            g[f"b{d}"] += dg.sum(axis=0)
            dx[t], dh, dc = dg @ wx.T, dg @ wh.T, dc * f
        return dx

    def emissions(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        """(time, batch, tags) scores of codes (batch, time)."""
        x = self.p["emb"][codes.T]
        forth, kf = self._lstm(x, "f")
        back, kb = self._lstm(x[::-1], "b")
        both = np.concatenate((forth, back[::-1]), axis=2)
        return both @ self.p["out"] + self.p["bias"], (x, kf, kb, both)

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log partition by row, tag marginals, summed pair marginals) by forward and backward sums."""
        trans = self.p["trans"]
        total = lambda v, axis: (m := v.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis=axis))
        a, b = np.empty_like(e), np.empty_like(e)
        a[0], b[-1] = e[0], 0
        for t in range(1, len(e)):
            a[t] = e[t] + total(a[t - 1][:, :, None] + trans, 1)
        for t in range(len(e) - 2, -1, -1):
            b[t] = total(trans + (e[t + 1] + b[t + 1])[:, None, :], 2)
        z = total(a[-1], 1)
        pairs = np.zeros_like(trans)
        for t in range(1, len(e)):
            pairs += np.exp(a[t - 1][:, :, None] + trans + (e[t] + b[t])[:, None, :] - z[:, None, None]).sum(axis=0)
        return z, np.exp(a + b - z[None, :, None]), pairs

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> dict:
        e, (x, kf, kb, both) = self.emissions(codes)
        _, marginal, pairs = self.marginals(e)
        n, (time, batch) = len(codes), e.shape[:2]
        de = marginal
        de[np.arange(time)[:, None], np.arange(batch), tags.T] -= 1
        de /= n
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        np.add.at(pairs, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
        g["trans"] = pairs / n
        g["out"] = both.reshape(-1, both.shape[2]).T @ de.reshape(-1, de.shape[2])
        g["bias"] = de.sum(axis=(0, 1))
        dboth = de @ self.p["out"].T
        h = self.hidden
        dx = self._lstm_back(x, kf, dboth[:, :, :h], "f", g)
        dx += self._lstm_back(x[::-1], kb, dboth[::-1, :, h:], "b", g)[::-1]
        np.add.at(g["emb"], codes.T.ravel(), dx.reshape(-1, dx.shape[2]))
        return g

    def fit(self, codes: np.ndarray, tags: np.ndarray, steps: int = 360, batch: int = 32, rate: float = 0.03, seed: int = 4) -> Tagger:
        rng = np.random.default_rng(seed)
        m1, m2 = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        for step in range(1, steps + 1):
            part = rng.integers(0, len(codes), batch)
            for k, g in self.gradients(codes[part], tags[part]).items():
                g = np.clip(g, -1, 1)
                m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.99 * m2[k] + 0.01 * g * g
                self.p[k] = self.p[k] - rate * (1 - step / (steps + 1)) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best tag path by Viterbi, its tags' marginals), each (batch, time)."""
        e, _ = self.emissions(codes)
        trans, best, back = self.p["trans"], e[0], []
        for t in range(1, len(e)):
            both = best[:, :, None] + trans
            back.append(both.argmax(axis=1))
            best = both.max(axis=1) + e[t]
        path = [best.argmax(axis=1)]
        for pointer in reversed(back):
            path.append(pointer[np.arange(len(pointer)), path[-1]])
        path = np.array(path[::-1])
        _, marginal, _ = self.marginals(e)
        return path.T, np.take_along_axis(marginal, path[:, :, None], 2)[:, :, 0].T

    def tagged(self, texts: list[str]) -> list[dict[int, tuple[int, float]]]:
        """Of each text the places that are not O: their tag and its probability, from the window in whose middle the place lies most."""
        cuts = [(i, a, b) for i, t in enumerate(texts) for a, b in windows(t)]
        out: list[dict[int, tuple[int, float]]] = [{} for _ in texts]
        votes = []
        for lo in range(0, len(cuts), 512):
            part = cuts[lo : lo + 512]
            codes = np.zeros((len(part), WINDOW), np.int64)
            for r, (i, a, b) in enumerate(part):
                codes[r, : b - a] = encode(texts[i][a:b])
            path, sure = self.decode(codes)
            text, start, end = (np.array(c)[:, None] for c in zip(*part))
            at = np.arange(WINDOW)[None, :] + start
            whole = np.array([len(texts[i]) for i, _, _ in part])[:, None]
            # a text's own ends are no ends of a window
            margin = np.minimum(np.where(start > 0, at - start, WINDOW), np.where(end < whole, end - 1 - at, WINDOW))
            inside = at < end
            votes.append([np.broadcast_to(x, at.shape)[inside] for x in (text, at, margin, path, sure)])
        if votes:
            text, at, margin, path, sure = (np.concatenate(c) for c in zip(*votes))
            order = np.lexsort((-margin, at, text))
            first = np.ones(len(order), bool)
            first[1:] = (text[order][1:] != text[order][:-1]) | (at[order][1:] != at[order][:-1])
            best = order[first]
            best = best[path[best] > 0]
            for i, x, tag, p in zip(text[best].tolist(), at[best].tolist(), path[best].tolist(), sure[best].tolist()):
                out[i][x] = tag, p
        return out

    def scored_spans(self, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
        """(start, end, kind, mean probability) of the runs of one kind's tags over each whole text, windows or not."""
        return [spans_of(seen) for seen in self.tagged(texts)]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Spans of each text that are as sure as the calibrated threshold."""
        return [[x[:3] for x in found if x[3] >= self.sure] for found in self.scored_spans(texts)]

    def calibrate(self, cases: list[tuple[str, list]]) -> Tagger:
        """Sets the least threshold at which plausible spans on (text, spans) are precise enough."""
        found = self.scored_spans([t for t, _ in cases])
        rated = [(p, (a, b, k) in spans) for (t, spans), rows in zip(cases, found) for a, b, k, p in rows if _plausible(t, (a, b, k))]
        good = [x for x in LEVELS if (kept := [ok for p, ok in rated if p >= x]) and sum(kept) >= PRECISION * len(kept)]
        self.sure = good[0] if good else LEVELS[-1]
        return self


def spans_of(tags: dict[int, tuple[int, float]]) -> list[tuple[int, int, int, float]]:
    """Spans of a text's tags by place: B begins one, I of its kind at the next place goes on with it."""
    out, run = [], []
    for at in [*sorted(tags), None]:
        tag, p = tags[at] if at is not None else (0, 0.0)
        if run and not (at == run[-1][0] + 1 and tag % 2 == 0 and tag == (run[0][1] + 1) // 2 * 2):
            out.append((run[0][0], run[-1][0] + 1, run[0][1] // 2, sum(r[2] for r in run) / len(run)))
            run = []
        if at is not None and (run or tag % 2):
            run.append((at, tag, p))
    return out


def _plausible(text: str, span: tuple[int, int, int]) -> bool:
    """Whether a learned span ends where words end and could be one of its kind: a sign for @ and one for a point, four parts up to 255, digits that pass Luhn, or enough digits."""
    a, b, kind = span
    part = text[a:b]
    digits = "".join(filter(str.isdigit, part))
    if (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()) or part != part.strip() or not part.isascii():
        return False
    if kind == 0:
        return bool(re.search(r"@|\bat\b", part) and re.search(r"\.|\bdot\b", part))
    if kind == 1:
        return len(parts := re.findall(r"[0-9]+", part)) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15 and len(digits) < len(part)


def all_spans(text: str, learned: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The rules' spans, and plausible learned ones that meet none of them."""
    base = base_spans(text)
    used = sorted((a, b) for a, b, _ in base)
    starts = [a for a, _ in used]
    reach = np.maximum.accumulate([b for _, b in used]) if used else []
    extra = [s for s in learned if _plausible(text, s) and not ((i := bisect_left(starts, s[1])) and reach[i - 1] > s[0])]
    return sorted(base + extra, key=lambda s: (s[0], s[2]))


def _digits(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _card(rng) -> str:
    head = str(rng.integers(3, 7)) + _digits(rng, 14)
    return next(head + str(d) for d in range(10) if luhn(head + str(d)))


def written(kind: int, rng) -> str:
    """A made-up span of a kind, in one of the ways that people write it: the rules' own, and such as they miss."""
    pick = lambda *options: options[rng.integers(len(options))]
    if kind == 0:
        word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(2, 9)))
        at, dot = pick(("@", "."), (" (at) ", "."), ("[at]", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("@", " [dot] "))
        return word() + pick("", f".{word()}", f"_{word()}", _digits(rng, 2)) + at + word() + pick("", _digits(rng, 1)) + pick("", dot + word()) + dot + pick("com", "org", "net", "de", "fr", "es", "io")
    if kind == 1:
        return pick(".", ".", "[.]", " . ", "(.)").join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        digits = _card(rng)
        return pick("", " ", "-", ".", "  ", " - ", "/", "_").join(digits[i : i + 4] for i in range(0, 16, 4))
    d = lambda n: _digits(rng, n)
    area = str(rng.integers(201, 990))
    return pick(
        f"+1 ({area}) {d(3)}-{d(4)}", f"+{rng.integers(30, 50)} {d(2)} {d(7)}", f"({area}) {d(3)}-{d(4)}", f"{area}-{d(3)}-{d(4)}", f"{area} {d(3)} {d(4)}", f"{area}.{d(3)}.{d(4)}",
        f"00{rng.integers(30, 50)} {d(2)} {d(7)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)} {d(3)} {d(3)}", f"1-8{d(2)}-{d(3)}-{d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}",
    )


def harmless(rng) -> str:
    """Digits and signs that are no personal data."""
    pick = lambda *options: options[rng.integers(len(options))]
    d, n = lambda k: _digits(rng, k), lambda a, b: int(rng.integers(a, b))
    return pick(
        f"{n(1900, 2030)}-{n(1, 13):02d}-{n(1, 29):02d}", f"{n(1, 29)}.{n(1, 13)}.{n(1900, 2030)}", f"{n(1, 29)}/{n(1, 13)}/{n(1900, 2030)}", f"{n(0, 24)}:{n(0, 60):02d}:{n(0, 60):02d}", f"v{n(0, 9)}.{n(0, 30)}.{n(0, 30)}",
        f"{n(1, 999)},{d(3)}.{d(2)}", f"{n(1, 99)} {d(3)},{d(2)}", f"{n(1900, 2000)}-{n(2000, 2030)}", f"978-3-{d(2)}-{d(6)}-{d(1)}", d(n(1, 12)), f"{n(1, 99)}.{n(1, 99)}", f"#{d(n(2, 7))}", f"@user{d(2)}", f"{n(1, 9)} @ {n(1, 90)} EUR",
        "".join(pick(*"0123456789abcdef") for _ in range(n(16, 41))), f"{n(1, 99)} {n(1, 99)} {n(1, 99)} {n(1, 99)}", f"{n(1, 9)}, {n(1, 9)}, {n(10, 99)}", f"{n(1, 99)}%", f"A{d(2)}-{d(4)}", f"{n(1, 30)}-{n(30, 90)} (at) noon",
    )


def training_cases(snippets: list[tuple[str, list]], rng) -> Iterator[tuple[str, list]]:
    """Each (text, spans) as it is, with its spans written in other ways or by harmless ones, and with something new put between two words."""
    for text, spans in snippets:
        yield text, spans
        out, moved, last = "", [], 0
        keep = rng.random() < 0.7
        for a, b, k in sorted(spans):
            if a >= last:
                part = written(k, rng) if keep else harmless(rng)
                out += text[last:a]
                moved += [(len(out), len(out) + len(part), k)] if keep else []
                out, last = out + part, b
        if spans:
            yield out + text[last:], moved
        gaps = [i for i, c in enumerate(text) if c == " " and not any(a <= i < b for a, b, _ in spans)]
        for kind in [*rng.permutation(4)[:2].tolist(), -1]:
            part = written(kind, rng) if kind >= 0 else harmless(rng)
            at = gaps[rng.integers(len(gaps))] + 1 if gaps else 0
            tail = part + (" " if gaps else "")
            new = [(at, at + len(part), kind)] if kind >= 0 else []
            yield text[:at] + tail + text[at:], sorted([(a, b, k) if b <= at else (a + len(tail), b + len(tail), k) for a, b, k in spans] + new)


def shaped(text: str) -> list[tuple[int, int, int]]:
    """The rules' spans and what is shaped as a card but fails Luhn: the tagger learns shapes, and `_plausible` counts."""
    base = base_spans(text)
    cards = [(m.start(), m.end(), 2) for m in _CARD.finditer(text) if 14 <= len(re.sub("[ -]", "", m[0])) <= 19]
    return sorted({*base, *(c for c in cards if not any(c[0] < b and a < c[1] for a, b, _ in base))})


def as_arrays(cases: list[tuple[str, list]], rng) -> tuple[np.ndarray, np.ndarray]:
    """(codes, tags) of one window of each case, around its spans or anywhere; a span that the window cuts is tagged as far as it goes."""
    codes, tags = np.zeros((len(cases), WINDOW), np.int64), np.zeros((len(cases), WINDOW), np.int64)
    for row, (text, spans) in enumerate(cases):
        middle = (spans[rng.integers(len(spans))][0] + int(rng.integers(-8, 40))) if spans else int(rng.integers(0, len(text) + 1))
        start = max(0, min(middle - WINDOW // 2, len(text) - WINDOW // 2))
        codes[row, : len(text[start : start + WINDOW])] = encode(text[start : start + WINDOW])
        for a, b, k in spans:
            x, y = max(a - start, 0), min(b - start, WINDOW)
            if x < y:
                tags[row, x:y] = 2 * k + 2
                if a >= start:
                    tags[row, x] = 2 * k + 1
    return codes, tags


def train(snippets: list[tuple[str, list]], seed: int = 11) -> Tagger:
    """A tagger from labelled snippets: four fifths train it, with their variants; the rest, with theirs, calibrate its threshold."""
    rng = np.random.default_rng(seed)
    held = [s for i, s in enumerate(snippets) if i % 5 == 0]
    cases = list(training_cases([s for i, s in enumerate(snippets) if i % 5] or snippets, rng))
    tagger = Tagger().fit(*as_arrays(cases, rng))
    return tagger.calibrate(list(training_cases(held, rng)))


def _snippets(batches):
    """Of each text its windows, wider by half a window, that hold a span or are among every eighth of the others: (doc_id, at, text, spans)."""
    for pdf in batches:
        rows = []
        for i, text in zip(pdf["doc_id"], pdf["text"]):
            spans = shaped(text)
            starts = [a for a, _, _ in spans]
            for at, (a, b) in enumerate(windows(text)):
                a, b = max(0, a - WINDOW // 4), b + WINDOW // 4
                inside = [(x, y, k) for x, y, k in spans[bisect_left(starts, a - 64) : bisect_left(starts, b)] if y > a and x < b]
                if inside or at % 8 == 0:
                    a, b = min([a, *(x for x, _, _ in inside)]), max([b, *(y for _, y, _ in inside)])
                    rows.append((i, at, text[a:b], [(x - a, y - a, k) for x, y, k in inside]))
        yield pd.DataFrame({"doc_id": [r[0] for r in rows], "at": [r[1] for r in rows], "text": [r[2] for r in rows], "spans": [[x for s in r[3] for x in s] for r in rows]})


def fit(docs: DataFrame, max_rows: int = TRAIN_ROWS, max_windows: int = TRAIN_WINDOWS) -> Tagger | None:
    """A tagger trained on at most max_windows windows of at most max_rows documents with a digit or an @; None if there are none.

    The labels are the rules' spans; written anew in ways that the rules miss,
    they teach the tagger what the rules cannot find. Rows that repeat a doc_id
    all count, within max_windows.
    """
    bounded_batches(docs.sparkSession)
    triggered = docs.where("text rlike '[0-9@]' and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    chosen = triggered.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    found = texts.mapInPandas(_snippets, "doc_id long, at long, text string, spans array<long>")
    first = found.orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at", "text").limit(max_windows).toPandas()
    if not len(first):
        return None
    return train([(t, [tuple(map(int, s[i : i + 3])) for i in range(0, len(s), 3)]) for t, s in zip(first["text"], first["spans"])])


def find_pii(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """docs' doc_id and an array `found` of struct(kind, start, end, text, learned), whole texts, code points, end exclusive.

    The rules' spans are always there; the tagger adds spans that meet none of
    them. A null or empty text has none; repeated rows give repeated rows; a
    null doc_id stays. Other columns are ignored. An empty table gives an
    empty table. A very long text is searched whole, in time linear in its
    length: the rules need one pass, the tagger looks at windows around digits,
    @, and "at" or "dot" in brackets. A learned span is no longer than what its
    windows tell of it.
    """

    @F.pandas_udf("array<struct<kind:string,start:int,end:int,text:string,learned:boolean>>")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out = []
            for lo in range(0, len(texts), 500):
                some = [t or "" for t in texts.iloc[lo : lo + 500]]
                learned = tagger.spans(some) if tagger else [[] for _ in some]
                for t, extra in zip(some, learned):
                    base = set(base_spans(t))
                    out.append([{"kind": KINDS[k], "start": a, "end": b, "text": t[a:b], "learned": (a, b, k) not in base} for a, b, k in all_spans(t, extra)])
            yield pd.Series(out)

    return docs.select(F.col("doc_id"), found("text").alias("found"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs, fit(docs))
    name = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("found", lambda x: ~x["learned"])
    count = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", name), ",").alias("spans"),
        F.size(F.filter("found", lambda x: x["learned"])).cast("long").alias("n_learned"),
    )
