"""Personal data: exact base rules, and spans found by a character BiLSTM with a CRF.

*Base spans* follow the patterns of :func:`base_spans` (leftmost, not
overlapping per kind, failing matches dropped).  The model adds spans and never
removes one.

*Model.*  Every character is a class (printable ASCII, other letter, a digit of
a number that a rule refused, ...); a bidirectional LSTM of ``HIDDEN`` units a
direction reads windows of ``WINDOW`` characters, and a CRF over the tags
(outside, and one tag a kind) decodes them.  Between two kinds the CRF has no
direct transition.  Its squashing function is z / (1 + |z|), which costs a
fraction of tanh.  It is written in numpy, forward and backward, and trained by
Adam on windows from a bounded sample of documents whose base spans are the
labels; the labelled spans in other spellings (``alternatives``) teach forms the
rules do not know, and ``DECOYS`` forms that are no personal data.

*Which spans are added.*  A span's score is the CRF's log-odds of its path
against staying outside.  Texts that were held out of training set the scores
from which each kind is added (:func:`calibrate`): precision ``PRECISION`` over
the spans in other spellings and all spans found in the plain texts, and no
score far beyond those of right spans.  A kind that does not reach it adds nothing.

*Whole texts.*  Windows overlap by ``OVERLAP`` characters and are decoded in
batches across documents.  Every window is scored; where no single run of a kind
gains over staying outside, the outside path is the best one and the Viterbi
search is not needed.  Windows are reconciled over the whole
text: each position takes its tag from the window in which it lies farthest from
an edge, and runs of equal tags become spans.  A model span is not added where it
touches a base span, or lies in one match that its own kind's rule has refused.

Defined results: NULL and empty texts have no spans; repeated rows get equal
answers; an empty table gives an empty result; other columns are ignored;
without any base span in the sample nothing is added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, SAMPLE_CHARS, HIDDEN, WINDOW, OVERLAP, BATCH = 3000, 1 << 16, 8, 512, 48, 2048
TRAIN_LENGTH, TRAIN_WINDOWS, EPOCHS, RATE, SEED = 128, 3300, 12, 0.02, 3
LONG_WINDOWS = 288  # training windows of WINDOW characters without spans
# One sampled text in HELD_OUT sets the least scores, each of its spans spelled RESPELLED times; the first span
# found in a plain text counts PLAIN times, because plain text is what there is most of.
HELD_OUT, RESPELLED, PRECISION, PLAIN = 4, 4, 0.9, 4

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # A match starts at the first of the local characters before its '@': the same as scanning from the left, but linear.
    last, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        s = at
        while m and s > last and text[s - 1] in _LOCAL:
            s -= 1
        if m and s < at:
            yield s, m.end()
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_matches(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, passes) of all matches of the base patterns."""
    out = [("email", s, e, True) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        ok = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
        out.append(("ip", m.start(), m.end(), ok))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        out.append(("card", m.start(), m.end(), 12 <= len(d) <= 19 and luhn(d)))
    for m in _PHONE.finditer(text):
        out.append(("phone", m.start(), m.end(), 9 <= len(_digits(m[0])) <= 15))
    return out


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; code points, end exclusive."""
    return in_order([(k, s, e) for k, s, e, ok in base_matches(text) if ok])


# --- characters -------------------------------------------------------------

CHARS = 102  # 0 padding, 1..95 printable ASCII, then space-like, other letter, other digit, other, line break, refused digit


def refused(found: list[tuple[str, int, int, bool]], text: str) -> list[tuple[int, int]]:
    """Numbers of the right length or form that a rule has looked at and refused (checksum, range)."""
    return [(s, e) for k, s, e, ok in found if not ok and (k == "ip" or k == "card" and 12 <= len(_digits(text[s:e])) <= 19)]


def classes(text: str, found: list | None = None) -> np.ndarray:
    """Class of each code point; ``found`` are the matches of the base rules."""
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.full(len(cp), 99, np.uint8)
    out[cp >= 0xC0] = 97
    out[(cp < 32) | (cp == 127) | (cp == 0xA0)] = 96
    out[cp == 10] = 100
    ascii_ = (cp >= 32) & (cp < 127)
    out[ascii_] = (cp[ascii_] - 31).astype(np.uint8)
    for s, e in refused(base_matches(text) if found is None else found, text):
        part = out[s:e]
        part[(part >= 17) & (part <= 26)] = 101
    return out


# --- the model --------------------------------------------------------------

TAGS = len(KINDS) + 1
NEVER = -1e4


def _allowed() -> np.ndarray:
    """Additive mask of the transitions: no step from one kind to another."""
    a = np.full((TAGS, TAGS), NEVER)
    a[0, :] = a[:, 0] = 0
    a[np.arange(TAGS), np.arange(TAGS)] = 0
    return a


class BiLstmCrf:
    """Parameters by name; arrays are laid out (units, batch) so that numpy works on long rows."""

    def __init__(self, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        g = 4 * hidden
        self.hidden = hidden
        # The scores with which a span is added: below, it is too unsure; far above any right span, it is like none of them.
        self.least, self.most = dict.fromkeys(KINDS, 0.0), dict.fromkeys(KINDS, np.inf)
        self.report: dict = {}
        self.p = {"out": rng.normal(0, 0.3, (TAGS, 2 * hidden)), "bias": np.zeros((TAGS, 1)), "trans": rng.normal(0, 0.1, (TAGS, TAGS))}
        for d in ("f", "b"):
            self.p[f"{d}x"] = rng.normal(0, 0.4, (g, CHARS))
            self.p[f"{d}x"][hidden:2 * hidden] += 1.0  # forget gates start open
            self.p[f"{d}h"] = rng.normal(0, 0.4, (g, hidden))

    # Gates are in the order input, forget, output, candidate; with s(z) = z / (1 + |z|) a gate is (1 + s(z)) / 2.

    def _steps(self, ids: np.ndarray, d: str, keep: list | None = None) -> Iterator[np.ndarray]:
        """States (H, B) after each of the characters ids (T, B); ``keep`` collects what the backward pass needs."""
        h_, (t_, b_) = self.hidden, ids.shape
        wx, wh = self.p[f"{d}x"].astype(np.float32), self.p[f"{d}h"].astype(np.float32)
        h, c = np.zeros((h_, b_), np.float32), np.zeros((h_, b_), np.float32)
        ids = ids.astype(np.intp)
        z, tmp, tc = np.empty((4 * h_, b_), np.float32), np.empty((4 * h_, b_), np.float32), np.empty((h_, b_), np.float32)
        for t in range(t_):
            before, prev = c, h
            if keep is not None:
                z, tc, c, h = np.empty_like(z), np.empty_like(tc), c.copy(), h.copy()
            np.take(wx, ids[t], axis=1, out=z, mode="clip")
            z += np.matmul(wh, prev, out=tmp)
            np.abs(z, out=tmp)
            tmp += 1
            z /= tmp
            gates = z[:3 * h_]
            gates *= 0.5
            gates += 0.5
            c *= z[h_:2 * h_]
            c += np.multiply(z[:h_], z[3 * h_:], out=tmp[:h_])
            np.abs(c, out=tc)
            tc += 1
            np.divide(c, tc, out=tc)
            np.multiply(z[2 * h_:3 * h_], tc, out=h)
            if keep is not None:
                keep.append((z, before, tc, prev))
            yield h

    def emissions(self, ids: np.ndarray, kept: tuple[list, list] | None = None):
        """(T, TAGS, B) scores of the tags; with ``kept`` also the states (T, 2 H, B)."""
        kf, kb = kept or (None, None)
        f = np.array([h.copy() for h in self._steps(ids, "f", kf)])
        b = np.array([h.copy() for h in self._steps(ids[::-1], "b", kb)])[::-1]
        states = np.concatenate([f, b], axis=1)
        e = np.matmul(self.p["out"].astype(np.float32), states) + self.p["bias"].astype(np.float32)
        return (e, states) if kept else e

    def gains(self, ids: np.ndarray) -> np.ndarray:
        """(T, TAGS - 1, B) scores of the kinds over outside, projected step by step while the states are in the cache."""
        w, bias = (self.p[x].astype(np.float32) for x in ("out", "bias"))
        w, bias, h_ = w[1:] - w[0], bias[1:] - bias[0], self.hidden
        out, tmp = np.empty((len(ids), TAGS - 1, ids.shape[1]), np.float32), np.empty((TAGS - 1, ids.shape[1]), np.float32)
        wf, wb = np.ascontiguousarray(w[:, :h_]), np.ascontiguousarray(w[:, h_:])
        for t, h in enumerate(self._steps(ids, "f")):
            np.matmul(wf, h, out=out[t])
        for t, h in enumerate(self._steps(ids[::-1], "b")):
            g = out[len(ids) - 1 - t]
            g += np.matmul(wb, h, out=tmp)
            g += bias
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Best tags (T, B)."""
        return self.best(ids)[0]

    def best(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tags (T, B), columns with a kind in them, emission gains over outside (T, those columns))."""
        cols, part = self.undecided(ids)
        tags = np.zeros(ids.shape, np.int8)
        tags[:, cols], own = self.paths(part)
        some = tags[:, cols].any(0)
        return tags, cols[some], own[:, some]

    def paths(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best tags, their gains over outside) of windows (T, TAGS, B) whose outside scores are zero."""
        if not scores.shape[2]:
            return np.zeros((len(scores), 0), np.int8), np.zeros((len(scores), 0), np.float32)
        tags = self._viterbi(scores, (self.p["trans"] + _allowed()).astype(np.float32))
        return tags, np.take_along_axis(scores, tags.astype(np.intp)[:, None], axis=1)[:, 0]

    def undecided(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(columns, scores (T, TAGS, those columns)) of the windows whose best path may leave the outside."""
        g, tr = self.gains(ids), (self.p["trans"] + _allowed()).astype(np.float32)
        stay, enter, leave, rest = np.diag(tr)[1:], tr[0, 1:], tr[1:, 0], tr[0, 0]
        # The best single run of each kind, by running sums of (gain + stay - rest) over its positions, and what entering
        # and leaving it costs (nothing at the ends of the window).  If no run is worth it, the outside path is the best one.
        shape, more = g.shape[1:], (stay - rest)[:, None]
        run, whole, term = (np.zeros(shape, np.float32) for _ in range(3))
        inner, first = (np.full(shape, -np.inf, np.float32) for _ in range(2))
        for row in g:
            np.add(row, more, out=term)
            np.maximum(run, 0, out=run)
            run += term
            whole += term
            np.maximum(inner, run, out=inner)
            np.maximum(first, whole, out=first)
        worth = np.max([inner + (enter + leave - stay - rest)[:, None], first + (leave - stay)[:, None],
                        run + (enter - stay)[:, None], whole + (rest - stay)[:, None]], axis=(0, 1))
        open_ = np.flatnonzero(worth > -1e-3)  # with room for rounding
        return open_, np.concatenate([np.zeros((len(ids), 1, len(open_)), np.float32), g[:, :, open_]], axis=1)

    def _viterbi(self, e: np.ndarray, tr: np.ndarray) -> np.ndarray:
        """Best paths; a kind is entered only from outside or itself."""
        t_, _, b_ = e.shape
        stay, enter, leave, rest = np.diag(tr)[1:, None], tr[0, 1:, None], tr[1:, 0, None], tr[0, 0]
        s = e[0].copy()
        entered, came = np.empty((t_, TAGS - 1, b_), bool), np.empty((t_, b_), np.int8)
        for t in range(1, t_):
            keep, new = s[1:] + stay, s[:1] + enter
            entered[t] = new > keep
            exits = s[1:] + leave
            best = s[0] + rest
            src = np.zeros(b_, np.int8)
            for k in range(TAGS - 1):
                better = exits[k] > best
                best = np.where(better, exits[k], best)
                src[better] = k + 1
            came[t] = src
            s = e[t].copy()
            s[1:] += np.maximum(keep, new)
            s[0] += best
        tags, cols = np.empty((t_, b_), np.int8), np.arange(b_)
        tags[-1] = s.argmax(axis=0)
        for t in range(t_ - 1, 0, -1):
            now = tags[t]
            inside = now > 0
            tags[t - 1] = np.where(inside, np.where(entered[t][np.maximum(now, 1) - 1, cols], 0, now), came[t])
        return tags

    def span_score(self, kind: str, gains: np.ndarray) -> float:
        """Log-odds of a span of the kind, given its emission gains, against staying outside."""
        k, tr = KINDS.index(kind) + 1, self.p["trans"]
        return float(gains.sum() + tr[0, k] + tr[k, 0] + (len(gains) - 1) * tr[k, k] - (len(gains) + 1) * tr[0, 0])

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of windows (T, B) and its gradient (forward-backward, then through time)."""
        kf, kb = [], []
        e, states = self.emissions(ids, (kf, kb))
        e = e.astype(float)
        t_, _, b_ = e.shape
        tr, cols = self.p["trans"] + _allowed(), np.arange(b_)

        def lse(x, axis):
            m = x.max(axis=axis, keepdims=True)
            return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, t_):
            alpha[t] = e[t] + lse(alpha[t - 1][:, None, :] + tr[:, :, None], 0)
        for t in range(t_ - 2, -1, -1):
            beta[t] = lse(tr[:, :, None] + (e[t + 1] + beta[t + 1])[None], 1)
        logz = lse(alpha[-1], 0)
        gold = e[np.arange(t_)[:, None], tags, cols].sum(0) + tr[tags[:-1], tags[1:]].sum(0)
        g_e = np.exp(alpha + beta - logz)
        g_e[np.arange(t_)[:, None], tags, cols] -= 1
        g = {"trans": np.zeros((TAGS, TAGS))}
        for t in range(1, t_):
            g["trans"] += np.exp(alpha[t - 1][:, None] + tr[:, :, None] + (e[t] + beta[t])[None] - logz).sum(-1)
        np.subtract.at(g["trans"], (tags[:-1].ravel(), tags[1:].ravel()), 1)
        g_e /= b_
        g["trans"] /= b_
        g["out"] = np.einsum("tkb,thb->kh", g_e, states)
        g["bias"] = g_e.sum((0, 2))[:, None]
        g_h = np.einsum("kh,tkb->thb", self.p["out"], g_e)
        h_ = self.hidden
        self._back(g, "f", ids, kf, g_h[:, :h_])
        self._back(g, "b", ids[::-1], kb, g_h[::-1, h_:])
        return float((logz - gold).mean()), g

    def _back(self, g: dict, d: str, ids: np.ndarray, kept: list, g_h: np.ndarray) -> None:
        h_, wh = self.hidden, self.p[f"{d}h"]
        gh, all_dz = np.zeros_like(wh), np.empty((len(ids), 4 * h_, g_h.shape[2]))
        dh = dc = np.zeros(g_h.shape[1:])
        for t in range(len(ids) - 1, -1, -1):
            z, before, tc, prev = kept[t]
            i, f, o, c = z[:h_], z[h_:2 * h_], z[2 * h_:3 * h_], z[3 * h_:]
            slope = np.square(1 - np.abs(2 * z[:3 * h_] - 1)) / 2  # of the gates; s'(z) = (1 - |s|)^2
            dh = dh + g_h[t]
            dc = dc + dh * o * np.square(1 - np.abs(tc))
            dz = all_dz[t]
            dz[:h_] = dc * c * slope[:h_]
            dz[h_:2 * h_] = dc * before * slope[h_:2 * h_]
            dz[2 * h_:3 * h_] = dh * tc * slope[2 * h_:]
            dz[3 * h_:] = dc * i * np.square(1 - np.abs(c))
            gh += dz @ prev.T
            dh, dc = wh.T @ dz, dc * f
        flat, order = ids.ravel(), np.argsort(ids.ravel(), kind="stable")
        seen, first = np.unique(flat[order], return_index=True)
        gx = np.zeros_like(self.p[f"{d}x"])
        gx[:, seen] = np.add.reduceat(all_dz.transpose(1, 0, 2).reshape(4 * h_, -1)[:, order], first, axis=1)
        g[f"{d}x"], g[f"{d}h"] = gx, gh

    def train(self, ids: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, size: int = 96, seed: int = SEED,
              more: tuple = ()) -> float:
        """Adam over windows (N, T), and ``more`` (ids, tags) of other lengths; the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        m, v, n, mean, groups = {}, {}, 0, 0.0, [(ids, tags), *more]
        for epoch in range(epochs):
            parts = [(g, part) for g, (x, _) in enumerate(groups) for part in np.split(rng.permutation(len(x)), range(size, len(x), size)) if len(part)]
            mean, total = 0.0, sum(len(x) for x, _ in groups)
            for p in rng.permutation(len(parts)):
                own, part = groups[parts[p][0]], parts[p][1]
                value, g = self.loss(own[0][part].T, own[1][part].T.astype(int))
                mean += value * len(part) / total
                n += 1
                for k, x in g.items():
                    x = np.clip(x, -5, 5)
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * x
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * x * x
                    self.p[k] -= rate * 0.85 ** epoch * (m[k] / (1 - 0.9 ** n)) / (np.sqrt(v[k] / (1 - 0.99 ** n)) + 1e-8)
        return mean


# --- training windows -------------------------------------------------------

def _jittered(s: str, rng: np.random.Generator) -> str:
    return "".join(str(int(rng.integers(0, 10))) if "0" <= c <= "9" and rng.random() < 0.5 else c for c in s)


def alternatives(kind: str, span: str, rng: np.random.Generator) -> str:
    """Another spelling of a labelled span that the rules do not match (some digits change)."""
    d = _digits(_jittered(span, rng))

    def pick(*forms):
        return forms[int(rng.integers(0, len(forms)))]
    if kind == "email":
        user, _, host = _jittered(span, rng).partition("@")
        at, dot = pick((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" AT ", " DOT "), (" @ ", "."), ("(at)", "."), (" at ", "."))
        return user + at + host.replace(".", dot)
    if kind == "phone" and len(d) >= 10:
        a, b, c = d[-10:-7], d[-7:-4], d[-4:]
        return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"001 {a} {b} {c}", f"1-{a}-{b}-{c}", f"{a}/{b}-{c}", f"+ 1 {a} {b} {c}")
    if kind == "ip":
        return pick("[.]", "(.)", " . ", " dot ", "[dot]").join(span.split("."))
    if kind == "card":
        groups = [span[i:i + 4] for i in range(0, len(span), 4)] if span.isdigit() else [d[i:i + 4] for i in range(0, len(d), 4)]
        return pick(".", "/", "_", " - ", "--", " / ", ", ").join(groups)
    return span


def _number(rng: np.random.Generator, digits: int) -> str:
    return "".join(str(int(x)) for x in rng.integers(0, 10, digits))


# Forms with digits and marks that are no personal data.
DECOYS = (lambda r: f"{r.integers(1900, 2100)}-{r.integers(1, 13):02d}-{r.integers(1, 29):02d}", lambda r: f"{r.integers(1, 29)}/{r.integers(1, 13)}/{r.integers(1990, 2030)}",
          lambda r: f"{r.integers(0, 24)}:{r.integers(0, 60):02d}", lambda r: f"{r.integers(0, 20)}.{r.integers(0, 20)}.{r.integers(0, 99)}",
          lambda r: f"{r.integers(1, 999)},{r.integers(0, 1000):03d}.{r.integers(0, 100):02d}", lambda r: f"({r.integers(1900, 2030)})",
          lambda r: _number(r, int(r.integers(2, 12))), lambda r: f"{_number(r, 3)}-{_number(r, 1)}-{_number(r, 2)}-{_number(r, 6)}-{_number(r, 1)}",
          lambda r: f"at {r.integers(1, 13)}", lambda r: r.bytes(int(r.integers(6, 20))).hex(), lambda r: f"[{r.integers(1, 99)}]", lambda r: "at", lambda r: "dot", lambda r: "@")


def respelled(text: str, span: tuple[str, int, int], rng: np.random.Generator, reach: int) -> tuple[str, int, int]:
    """(the text around a span in which it is spelled otherwise, start and end of the new spelling)."""
    k, s, e = span
    new, left = alternatives(k, text[s:e], rng), text[max(0, s - reach):s]
    return left + new + text[e:e + reach], len(left), len(left) + len(new)


# What a training window is centred on: a span as it is (0-2), spelled otherwise (3-6), a match that fails (7), a decoy (8),
# any place (9), a word repeated many times (10).
WAYS = tuple(range(11))


def windows(texts: list[str], length: int = TRAIN_LENGTH, limit: int = TRAIN_WINDOWS, seed: int = SEED,
            ways: tuple[int, ...] = WAYS) -> tuple[np.ndarray, np.ndarray]:
    """(ids, tags) of training windows, the ``ways`` in turn."""
    rng = np.random.default_rng(seed)
    texts = [t for t in texts if t]
    spans, other = [], []
    for n, text in enumerate(texts):
        for k, s, e, ok in base_matches(text):
            (spans if ok else other).append((n, k, s, e))
    if not spans:
        return np.empty((0, length), np.uint8), np.empty((0, length), np.int8)
    # Kinds in equal shares, so that a frequent kind does not crowd out a rare one.
    by_kind = [x for x in ([x for x in spans if x[1] == k] for k in KINDS) if x]
    denied = [x for x in other if refused([(*x[1:], False)], texts[x[0]])]
    ids, tags = [], []
    for i in range(limit):
        way = ways[i % len(ways)]
        if way < 7:
            own = by_kind[(i // len(ways) * 7 + way) % len(by_kind)]
            n, k, s, e = own[int(rng.integers(0, len(own)))]
        else:
            n = int(rng.integers(0, len(texts)))
            k, s = None, int(rng.integers(0, len(texts[n])))
            e = s
            if way == 7 and other:
                some = denied if denied and rng.random() < 0.6 else other
                n, _, s, e = some[int(rng.integers(0, len(some)))]
        near, a = texts[n][max(0, s - length):e + length], max(0, s - length)
        new = None
        if 3 <= way < 7:
            near, s, e = respelled(texts[n], (k, s, e), rng, length)
            a, new = 0, k
        elif way == 8:
            decoy = DECOYS[int(rng.integers(0, len(DECOYS)))](rng)
            near, e = f"{near[:s - a]} {decoy} {near[s - a:]}", s + len(decoy) + 2
        elif way == 10 and (words := [w for w in near.split() if w.isalpha()]):
            again = f"{words[int(rng.integers(0, len(words)))]} " * int(rng.integers(2, length // 2))
            near, e = f"{near[:s - a]} {again}{near[s - a:]}", s + len(again)
        marks, matches = np.zeros(len(near), np.int8), base_matches(near)
        if any(kk == "card" and not ok and len(_digits(near[ss:ee])) > 19 for kk, ss, ee, ok in matches):
            continue  # several numbers that the rule takes for one: no label says what they are
        for kk, ss, ee, ok in matches:
            if ok:
                marks[ss:ee] = KINDS.index(kk) + 1
        if new:
            marks[s:e] = KINDS.index(new) + 1
        x, centre = classes(near), (s + e) // 2 - a
        first = max(0, min(centre - int(rng.integers(length // 4, length - length // 4)), len(near) - length))
        x, y = x[first:first + length], marks[first:first + length]
        ids.append(np.pad(x, (0, length - len(x))))
        tags.append(np.pad(y, (0, length - len(y))))
    return np.array(ids, np.uint8), np.array(tags, np.int8)


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_DOCS) -> list[str]:
    """Texts for training, at most ``rows`` of up to ``SAMPLE_CHARS`` characters: about half of them with a digit or '@', half any.

    Two scans: the counts say which share of the hashes to take, and the chosen texts leave their tasks.
    """
    text = F.col(f"`{text_col}`").cast("string")
    src = docs.where((F.length(text) > 0) & (F.length(text) <= SAMPLE_CHARS)).select(
        text.alias("t"), F.shiftrightunsigned(F.xxhash64(F.col(f"`{id_col}`"), F.length(text)), 1).alias("h"), text.rlike("[0-9@]").alias("marked"))
    n = src.agg(F.count(F.lit(1)).alias("n"), F.count_if("marked").alias("m")).first()

    def below(count: int):
        return F.col("h") <= int(min(1.0, rows / 2 / max(1, count)) * (2 ** 63 - 1024))
    chosen = src.where(below(n["n"]) | (F.col("marked") & below(n["m"])))
    return [r["t"] for r in chosen.orderBy("h", "t").limit(rows).toLocalIterator()]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> BiLstmCrf | None:
    """Train and calibrate on the driver from the bounded sample; None if the sample has no base span."""
    texts = sample(docs, id_col, text_col)
    held = [t for i, t in enumerate(texts) if i % HELD_OUT == 0]
    own = [t for i, t in enumerate(texts) if i % HELD_OUT] or texts
    ids, tags = windows(own)
    if not len(ids):
        return None
    model = BiLstmCrf()
    # Windows of the length that is decoded, so that long stretches of one kind do not carry the states away.
    model.train(ids, tags, more=[windows(own, WINDOW, LONG_WINDOWS, ways=(9, 10, 10))])
    calibrate(model, held)
    return model


def respelled_spans(texts: list[str], seed: int = SEED, times: int = RESPELLED, reach: int = 200) -> list[tuple[str, tuple[str, int, int]]]:
    """(a piece of text, the span in it): every base span of the texts, spelled otherwise ``times`` times."""
    rng, out = np.random.default_rng(seed), []
    for text in texts:
        for k, s, e in base_spans(text):
            for _ in range(times):
                near, a, b = respelled(text, (k, s, e), rng, reach)
                out.append((near, (k, a, b)))
    return out


def same_span(a: tuple[str, int, int], b: tuple[str, int, int], share: float = 0.7) -> bool:
    """Whether two spans of one kind are the same but for a few characters at their ends: common part over union."""
    return a[0] == b[0] and min(a[2], b[2]) - max(a[1], b[1]) >= share * (max(a[2], b[2]) - min(a[1], b[1]))


def calibrate(model: BiLstmCrf, texts: list[str], precision: float = PRECISION) -> None:
    """Set the least (and the greatest) score of each kind from texts that the model has not seen, and ``model.report``.

    Right are the spans (:func:`same_span`) that other spellings of the texts' own base spans have;
    wrong is everything else that would be added to those pieces, and to the
    plain texts.  The report has (precision, recall, spans) of each kind.
    """
    pieces, edge = respelled_spans(texts), 48
    every = [p for p, _ in pieces] + texts
    want = [{x} for _, x in pieces] + [set()] * len(texts)
    model.least, model.most = dict.fromkeys(KINDS, -np.inf), dict.fromkeys(KINDS, np.inf)
    found: dict[str, list[tuple[float, int]]] = {k: [] for k in KINDS}
    for at in range(0, len(every), 256):
        part = every[at:at + 256]
        for text, own, marks in zip(part, want[at:], marks_of(part, model)):
            seen = set()
            for span, score in sorted(added_spans(text, base_matches(text), marks, model), key=lambda x: -x[1]):
                if not own and span[0] in seen:
                    continue
                seen.add(span[0])
                # A piece may cut another span at its ends: what is found there is neither right nor wrong.
                right = any(same_span(span, x) for x in own)
                if not own or right or span[1] >= edge and span[2] <= len(text) - edge:
                    found[span[0]].append((score, 1 if right else -1 if own else -PLAIN))
    for k in KINDS:
        total = sum(x[0] == k for _, x in pieces)
        model.most[k] = 1.25 * max((score for score, w in found[k] if w > 0), default=0.0)
        rows = sorted((x for x in found[k] if x[0] <= model.most[k]), reverse=True)
        right, all_ = np.cumsum([w > 0 for _, w in rows]), np.cumsum([abs(w) for _, w in rows])
        good = [i for i in range(len(rows)) if right[i] >= precision * all_[i] and (i + 1 == len(rows) or rows[i + 1][0] < rows[i][0])]
        model.least[k] = rows[good[-1]][0] if good else np.inf
        model.report[k] = (right[good[-1]] / (good[-1] + 1), right[good[-1]] / total, total) if good else (0.0, 0.0, total)


# --- whole texts ------------------------------------------------------------

def marks_of(texts: list[str], model: BiLstmCrf, founds: list | None = None, window: int = WINDOW, overlap: int = OVERLAP,
             batch: int = BATCH) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """(tags, emission gains of the tagged positions) of each whole text, reconciled over its overlapping windows.

    ``founds`` are the base matches of each text; the gains are None where a text has no tag.
    """
    step = window - overlap
    where, pieces, held = [], [], []
    kinds = [classes(t, founds[n] if founds else None) for n, t in enumerate(texts)]
    out: list = [(np.zeros(len(k), np.int8), None) for k in kinds]

    def flush() -> None:
        width = max(len(p) for p in pieces)
        ids = np.zeros((width, len(pieces)), np.uint8)
        for j, p in enumerate(pieces):
            ids[:len(p), j] = p
        cols, scores = model.undecided(ids)
        held.extend((*where[j], len(pieces[j]), scores[:, :, c]) for c, j in enumerate(cols.tolist()))
        where.clear()
        pieces.clear()
        if len(held) >= batch:
            search()

    def search() -> None:
        """The few undecided windows of many batches together: a Viterbi step costs the same for one."""
        scores = np.zeros((max(len(x[3]) for x in held), TAGS, len(held)), np.float32)
        scores[:, 1:] = NEVER  # behind the end of a shorter window, outside
        for c, x in enumerate(held):
            scores[:len(x[3]), :, c] = x[3]
        tags, gains = model.paths(scores)
        for c, (n, s, size, _) in enumerate(held):
            if tags[:, c].any():
                # A position belongs to the window in which it is farther from an edge: half of the overlap each.
                a, b = (overlap // 2 if s else 0), (size if s + size == len(kinds[n]) else size - (overlap - overlap // 2))
                if out[n][1] is None:
                    out[n] = (out[n][0], np.zeros(len(kinds[n]), np.float32))
                out[n][0][s + a:s + b] = tags[a:b, c]
                out[n][1][s + a:s + b] = gains[a:b, c]
        held.clear()

    # Short pieces together, so that little of a batch is padding.
    todo = sorted(((n, s) for n, k in enumerate(kinds) for s in range(0, max(1, len(k) - overlap), step) if len(k)),
                  key=lambda x: min(window, len(kinds[x[0]]) - x[1]))
    for n, s in todo:
        where.append((n, s))
        pieces.append(kinds[n][s:s + window])
        if len(pieces) == batch:
            flush()
    if pieces:
        flush()
    if held:
        search()
    return out


def tags_of(texts: list[str], model: BiLstmCrf, **options) -> list[np.ndarray]:
    """Tags of every position of each whole text (:func:`marks_of`)."""
    return [t for t, _ in marks_of(texts, model, **options)]


# Characters with which a model span of a kind may begin and end; a run of tags is cut to them.
_ENDS = {"email": (re.compile(r"[A-Za-z0-9]"),) * 2, "ip": (re.compile(r"[0-9]"),) * 2, "card": (re.compile(r"[0-9]"),) * 2,
         "phone": (re.compile(r"[0-9+(]"), re.compile(r"[0-9]"))}


def model_spans(text: str, tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Runs of equal tags, cut to characters with which their kind begins and ends."""
    edge = np.flatnonzero(np.diff(tags, prepend=0, append=0))
    out = []
    for s, e in zip(edge, edge[1:]):
        if tags[s]:
            kind = KINDS[tags[s] - 1]
            begin, end = _ENDS[kind]
            while s < e and not begin.match(text[s]):
                s += 1
            while e > s and not end.match(text[e - 1]):
                e -= 1
            if s < e:
                out.append((kind, int(s), int(e)))
    return out


def added_spans(text: str, found: list, marks: tuple[np.ndarray, np.ndarray | None], model: BiLstmCrf) -> Iterator[tuple[tuple[str, int, int], float]]:
    """(span, score) of the model's spans beside the base rules, from their least score on."""
    tags, gains = marks
    if gains is None:
        return
    for k, s, e in model_spans(text, tags):
        # Not on a base span, nor inside one match that the rule of the kind has refused.
        if any(x[1] < e and s < x[2] and (x[3] or x[0] == k and x[1] <= s and e <= x[2] and k != "phone") for x in found):
            continue
        score = model.span_score(k, gains[s:e])
        if model.least[k] <= score <= model.most[k]:
            yield (k, s, e), score


def all_spans(text: str, marks: tuple[np.ndarray, np.ndarray | None] | None, model: BiLstmCrf | None, found: list | None = None) -> tuple[list, list]:
    """(base spans, base and added spans), both in order."""
    found = base_matches(text) if found is None else found
    base = in_order([(k, s, e) for k, s, e, ok in found if ok])
    added = [x for x, _ in added_spans(text, found, marks, model)] if marks is not None else []
    return base, in_order(base + added)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, model: BiLstmCrf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    kind = dict(docs.dtypes)[id_col]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    names = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            founds = [base_matches(t) for t in texts]
            marks = marks_of(texts, own, founds) if own is not None else [None] * len(texts)
            rows = [all_spans(t, m, own, x) for t, m, x in zip(texts, marks, founds)]
            counts = [pa.array([sum(x[0] == k for x in base) for base, _ in rows], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts, pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows]),
                 pa.array([joined(every) for _, every in rows])], ["_id", *names, "base_sha256", "spans"])
    out = src.mapInArrow(run, f"_id {kind}, " + ", ".join(f"{n} bigint" for n in names) + ", base_sha256 string, spans string")
    return out.withColumnRenamed("_id", id_col)
