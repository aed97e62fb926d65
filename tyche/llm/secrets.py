"""Secret scans: fixed patterns, and a character convolutional network over every candidate token.

The patterns' findings always stay. Tokens of 12 or more key-like characters, not letters alone, or of 16 or more of
any kind are candidates; the network reads each with its surroundings as character classes, one of more than
``INSIDE`` characters in several windows of which the highest score counts. A candidate is found unless the patterns'
findings cover its letters and digits. It is trained here on the candidates of all documents, labelled by the
patterns. Each finding is also shown without what the patterns go by, its keyword or prefix, and between other
surroundings, so that a key's own form must tell. A candidate that is no finding may still be a secret: the loss of
findings is logarithmic, that of other candidates their score, which hardly pulls at those that look like keys. A
third of the keys, with all that is shown of them, is held out; it calibrates the scores and sets the threshold: the
highest that keeps ``RECALL`` of keys that training has not seen, or half way from there to what is no secret, if all
of that scores lower.

Training takes ``ROUNDS`` rounds. The windows are dealt to shards of about ``SHARD``; in a round each shard starts at
the common state, passes over all its windows, and the mean of the shards' states is the next common state.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept, mapped
from .token_counts import balanced

log = logging.getLogger(__name__)

# The patterns of the three kinds of findings.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "net")
CANDIDATE = re.compile(r"(?=[A-Za-z.]*[0-9+/_=-])[A-Za-z0-9+/_=.-]{12,}|[A-Za-z0-9+/_=.-]{16,}")

SPACE = re.compile(r"\s")

#: The share of held-out secrets that the network must keep.
RECALL = 0.99
#: Characters read before, of and after a candidate; filters and their width.
BEFORE, INSIDE, AFTER, FILTERS, WIDTH = 20, 40, 12, 16, 5
LENGTH = BEFORE + INSIDE + AFTER
#: Rounds of training, updates of a shard in a round, at least, windows of an update and, about, of a shard.
ROUNDS, UPDATES, BATCH, SHARD = 8, 100, 128, 8192
#: Character classes; a byte's class is the last of these that holds it. 0 is padding, 1 any other byte.
CLASSES = ("", "", "ghijklmnopqrstuvwxyz", "GHIJKLMNOPQRSTUVWXYZ", "abcdef", "ABCDEF", "0123456789", " \t", "\r\n", "\"'`", "=", ":", "-_", "+/", ".,;!?", "()[]{}<>")
CLASS_OF = np.ones(256, np.int64)
for _k, _chars in enumerate(CLASSES):
    CLASS_OF[[ord(c) for c in _chars]] = _k
CHANNELS = len(CLASSES) + 1
#: A window's byte as its class, one-hot, and whether it lies inside the candidate.
ONE_HOT = np.concatenate([np.eye(128, len(CLASSES), dtype=np.float32)[np.arange(256) & 127], np.arange(256, dtype=np.float32)[:, None] // 128], 1)
#: Numbers that a network learns: filters, biases, weights of the logistic unit and its shift.
PARAMS = WIDTH * CHANNELS * FILTERS + FILTERS + 2 * FILTERS + 1
Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """The patterns' findings, leftmost and non-overlapping per kind, ordered by start, then kind."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def window(text: str, start: int, end: int) -> bytes:
    """A candidate's classes and place: ``LENGTH`` bytes of classes with 128 added inside the candidate.

    Of a candidate of more than ``INSIDE`` characters these are the first, before what follows its end.
    """
    stop = min(end, start + INSIDE)
    head = text[max(0, start - BEFORE) : start].encode("latin-1", "replace").rjust(BEFORE, b"\0")
    body, tail = text[start:stop].encode("latin-1", "replace"), text[end : end + AFTER].encode("latin-1", "replace")
    classes = CLASS_OF[np.frombuffer(head + body + tail.ljust(AFTER, b"\0"), np.uint8)].astype(np.uint8)
    classes[: BEFORE - min(start, BEFORE)] = 0
    classes[BEFORE : BEFORE + len(body)] += 128
    return classes.tobytes().ljust(LENGTH, b"\0")


def window_starts(start: int, end: int) -> list[int]:
    """Where the windows of a candidate begin: half a window apart, the last at its end."""
    return [*range(start, end - INSIDE, INSIDE // 2), max(start, end - INSIDE)]


def key_of(text: str, span: Span) -> tuple[int, int]:
    """Where the key of a finding is, without the keyword or prefix that gave it away."""
    start, end, kind = span
    return ASSIGN.match(text, start, end).span(2) if kind == "assign" else (start + len("AKIA") * (kind == "access"), end)


def covered(text: str, start: int, end: int, spans: list[Span]) -> bool:
    """Whether all letters and digits of a candidate lie in ``spans``, which are ordered by start."""
    for s in spans:
        if s[0] < end and start < s[1]:
            if any(c.isalnum() for c in text[start : s[0]]):
                return False
            start = s[1]
    return not any(c.isalnum() for c in text[start:end])


def surroundings(text: str, draw: int) -> tuple[bytes, bytes]:
    """The classes before and after a white space of ``text``, the next after the place that ``draw`` gives; at the text's end, if none follows."""
    space = SPACE.search(text, draw % (len(text) + 1))
    at = space.start() if space else len(text)
    start = min(at + 1, len(text))
    return window(text, start, start)[:BEFORE], window(text, at, at)[BEFORE:][:AFTER]


def stacked(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(windows), np.uint8).reshape(-1, LENGTH)


def tensors(raw: np.ndarray) -> np.ndarray:
    """One-hot classes and an inside flag of stacked windows: (windows, positions, width * channels) patches."""
    patches = np.lib.stride_tricks.sliding_window_view(ONE_HOT[raw], WIDTH, axis=1)
    return patches.reshape(len(raw), LENGTH - WIDTH + 1, -1)


@dataclass
class Network:
    """A convolution with rectifiers, maximum and mean pooling, and a logistic unit, then calibration and threshold."""

    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    scale: float = 1.0
    offset: float = 0.0
    threshold: float = 2.0
    recall: float = 0.0  # the share of held-out secrets that the threshold keeps

    @classmethod
    def of(cls, params: np.ndarray) -> Network:
        """The network of ``PARAMS`` numbers; the arrays are views of these."""
        filters, bias, out, shift = np.split(params, np.cumsum([WIDTH * CHANNELS * FILTERS, FILTERS, 2 * FILTERS]))
        return cls(filters.reshape(-1, FILTERS), bias, out, float(shift[0]))

    def logits(self, windows: list[bytes]) -> np.ndarray:
        if not windows:
            return np.zeros(0, np.float32)
        parts = [self._forward(tensors(stacked(windows[k : k + 512])))[0] for k in range(0, len(windows), 512)]
        return np.concatenate(parts)

    def scores(self, windows: list[bytes]) -> np.ndarray:
        return self.calibrated(self.logits(windows))

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(logits * self.scale + self.offset)))

    def calibrate(self, z: np.ndarray, secrets: np.ndarray, others: np.ndarray) -> None:
        """Platt's scaling by how many held-out secrets and others have each logit."""
        n = (secrets + others).sum()
        for _ in range(300):
            d = (secrets + others) / (1 + np.exp(-(z * self.scale + self.offset))) - secrets
            self.scale -= 0.1 * float((d * z).sum() / n) / (1 + float(((secrets + others) * z * z).sum() / n))
            self.offset -= 0.1 * float(d.sum() / n)

    def settle(self, least: float, highest: float) -> np.float32:
        """Sets the threshold by the lowest logit of a secret that must be kept and the highest of what is none; the threshold's logit."""
        cut = np.float32(min(least, (least + highest) / 2))
        self.threshold = float(self.calibrated(np.array([cut], np.float32))[0])
        return cut

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.filters + self.bias, 0)
        pooled = np.concatenate([h.max(1), h.mean(1)], 1)
        return (pooled * self.out).sum(1) + np.float32(self.shift), h, pooled


def first_state(seed: int) -> np.ndarray:
    """Where training starts: the numbers of a network, Adam's two moments of each, and how many updates there were."""
    rng = np.random.default_rng(seed)
    drawn = [rng.normal(0, 0.1, WIDTH * CHANNELS * FILTERS), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), np.zeros(1)]
    return np.concatenate([*drawn, np.zeros(2 * PARAMS + 1)])


def updated(state: np.ndarray, raw: np.ndarray, labels: np.ndarray, share: float, seed: list[int]) -> np.ndarray:
    """The state after whole passes of Adam over stacked windows, as many as make ``UPDATES`` updates; ``share`` of all windows are secrets."""
    rng = np.random.default_rng(seed)
    p, m, v = state[:-1].astype(np.float32).reshape(3, -1)
    y, step = labels.astype(np.float32), state[-1]
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    batches = ceil(len(y) / BATCH)
    for _ in range(ceil(UPDATES / batches)):
        for at in np.array_split(rng.permutation(len(y)), batches):
            net, x = Network.of(p), tensors(raw[at])
            z, h, pooled = net._forward(x)
            score = 1 / (1 + np.exp(-z))
            d = np.where(y[at] == 1, score - 1, score * (1 - score)) * weight[at] / len(at)
            dp = d[:, None] * net.out
            dh = np.broadcast_to(dp[:, None, FILTERS:] / h.shape[1], h.shape).copy()
            np.put_along_axis(dh, h.argmax(1)[:, None], np.take_along_axis(dh, h.argmax(1)[:, None], 1) + dp[:, None, :FILTERS], 1)
            dh *= h > 0
            grads = [x.reshape(-1, x.shape[2]).T @ dh.reshape(-1, FILTERS), dh.sum((0, 1)), pooled.T @ d, d.sum()]
            g = np.concatenate([x.ravel() for x in grads])
            step += 1
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return np.concatenate([p, m, v, [step]]).astype(np.float64)


def train(windows: list[bytes] | DataFrame, labels: np.ndarray | None = None, groups: np.ndarray | None = None, seed: int = 7, recall: float = RECALL) -> Network:
    """Trained on two thirds, calibrated by Platt's scaling on the rest; without both classes in both it finds nothing.

    Windows of one of the ``groups`` (each its own by default) are all trained on or all held out. Instead of lists
    there may be a table as :func:`labelled` gives it; Spark then trains on all its rows, ``token`` being the group.
    """
    if isinstance(windows, DataFrame):
        return trained_on_table(windows, seed, recall)
    rng, state = np.random.default_rng(seed), first_state(seed)
    raw, group = stacked(windows), np.unique(np.arange(len(labels)) if groups is None else groups, return_inverse=True)[1]
    held = (rng.random(len(labels)) < 1 / 3)[group]
    if len(labels) < 30 or any(labels[part].min() == labels[part].max() for part in (held, ~held)):
        return Network.of(state[:PARAMS].astype(np.float32))
    own = rng.permutation(np.flatnonzero(~held))
    shards = np.array_split(own, ceil(len(own) / SHARD))
    for n in range(ROUNDS):
        state = np.mean([updated(state, raw[at], labels[at], labels[own].mean(), [seed, n, k]) for k, at in enumerate(shards)], 0)
    net = Network.of(state[:PARAMS].astype(np.float32))
    z, y = net.logits([windows[k] for k in np.flatnonzero(held)]), labels[held]
    net.calibrate(z.astype(float), y == 1, y == 0)
    secrets = np.sort(z[y == 1])
    cut = net.settle(float(secrets[min(int((1 - recall) * len(secrets)), len(secrets) - 1)]), float(z[y == 0].max()))
    net.recall = float((secrets >= cut).mean())
    return net


def trained_on_table(rows: DataFrame, seed: int, recall: float) -> Network:
    """Trained on each row whose token is not held out, calibrated and cut by all held-out rows, each as often as it occurs.

    Shards and halves are dealt by hashes and sums are decimal, so the network does not depend on how tasks get the rows.
    """
    rows = kept(rows.withColumn("held", F.pmod(F.xxhash64("token"), F.lit(3)) == 0), "labelled")
    seen = {(r.held, r.label): r for r in rows.groupBy("held", "label").agg(F.count("*").alias("windows"), F.sum("n").alias("n")).collect()}
    state = first_state(seed)
    if len(seen) < 4 or sum(r.windows for r in seen.values()) < 30:
        return Network.of(state[:PARAMS].astype(np.float32))
    own = [seen[False, label].windows for label in (0, 1)]
    share, parts = own[1] / sum(own), ceil(sum(own) / SHARD)
    dealt = rows.filter("not held").select(F.pmod(F.xxhash64("window", "label", "token"), F.lit(parts)).alias("shard"), "window", "label").repartition(parts, "shard")
    shards = kept(dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("window", "label"))).alias("shown")), "shards")
    for n in range(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], state: np.ndarray = state, n: int = n) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, shown in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    raw, labels = stacked(shown.values.field("window").to_pylist()), shown.values.field("label").to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array([updated(state, raw, labels, share, [seed, n, shard])])], ["state"])

        states = mapped(shards, run, "state array<double>").select(F.posexplode("state").alias("at", "x"))
        means = states.groupBy("at").agg(F.avg(F.col("x").cast("decimal(30,18)")).cast("double").alias("x"))
        state = np.array([r.x for r in sorted(means.collect())])  # of any table the same number of rows
    net = Network.of(state[:PARAMS].astype(np.float32))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = net.logits(batch.column(0).to_pylist())
            bits = z.view(np.int32)  # as whole numbers of the same order
            key = np.where(bits < 0, bits ^ 0x7FFFFFFF, bits).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(z, pa.float32()), pa.array(key >> 16, pa.int32())], ["label", "n", "z", "bin"])

    scored = kept(mapped(rows.filter("held").select("window", "label", "n"), score, "label int, n long, z float, bin int"), "held-out")
    sums = scored.groupBy("bin", "label").agg(F.sum("n").alias("n"), F.max("z").alias("highest")).orderBy("bin", "label").collect()  # 2 * 65,536 rows at most
    z, y, count = np.array([r.highest for r in sums], float), np.array([r.label for r in sums]), np.array([r.n for r in sums], float)
    net.calibrate(z, count * (y == 1), count * (y == 0))
    # The secret at the place that the recall gives: first its bin, then the logit within, 65,536 at most.
    total = seen[True, 1].n
    left = min(int((1 - recall) * total), total - 1)
    for r in sums:
        if r.label == 1 and left < r.n:
            break
        left -= r.n * r.label
    for own_bin in scored.filter((F.col("label") == 1) & (F.col("bin") == r.bin)).groupBy("z").agg(F.sum("n").alias("n")).orderBy("z").collect():
        if left < own_bin.n:
            break
        left -= own_bin.n
    cut = net.settle(own_bin.z, max(x.highest for x in sums if x.label == 0))
    net.recall = scored.filter((F.col("label") == 1) & (F.col("z") >= F.lit(float(cut)))).agg(F.sum("n")).first()[0] / total
    return net


def labelled(docs: DataFrame) -> DataFrame:
    """``window, label, token, n``: the labelled windows of all rows of ``docs``, each once, with the hash of the key or token shown and how often it occurs.

    A candidate that an assignment or access key covers, or a hexadecimal finding with letters and digits, is a
    secret. The key of each finding is also shown alone, as it is and its first 14 characters, both also with their cases
    swapped, between the surroundings of a white space of its text. A window of a longer candidate is a secret if it holds 12 characters of the key, and left out if it holds fewer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in balanced(batches, 0):
            shown, labels, tokens = [], [], []
            for text in batch.column(0).to_pylist():
                spans = base_spans(text)
                for m in CANDIDATE.finditer(text):
                    over = [s for s in spans if s[0] < m.end() and m.start() < s[1]]
                    keys = [s for s in over if s[2] != "hex" or re.search("[a-f]", text[s[0] : s[1]]) and re.search("[0-9]", text[s[0] : s[1]])]
                    token = crc32((text[slice(*key_of(text, keys[0]))] if keys else m[0]).encode())
                    for at in window_starts(*m.span()):
                        stop = min(m.end(), at + INSIDE)
                        seen = [(min(s[1], stop) - max(s[0], at), min(s[1], m.end()) - max(s[0], m.start())) for s in keys]
                        secret = any(n >= min(12, whole) for n, whole in seen)
                        if not secret and any(n > 0 for n, _ in seen):
                            continue
                        shown.append(window(text, at, m.end()))
                        labels.append(int(secret))
                        tokens.append(token)
                    for start, end in map(lambda s, text=text: key_of(text, s), keys):
                        token = crc32(text[start:end].encode())
                        head, tail = surroundings(text, token)
                        for key in (shown_as for k in (text[start:end], text[start : start + 14]) for shown_as in (k, k.swapcase())):
                            inside = window(key, 0, len(key))[BEFORE : BEFORE + min(INSIDE, len(key))]
                            shown.append((head + inside + tail).ljust(LENGTH, b"\0"))
                            labels.append(1)
                            tokens.append(token)
            yield pa.RecordBatch.from_arrays([pa.array(shown, pa.binary()), pa.array(labels, pa.int32()), pa.array(tokens, pa.int64())], ["window", "label", "token"])

    rows = mapped(docs.select(F.coalesce("text", F.lit("")).alias("text")), run, "window binary, label int, token long")
    return rows.groupBy("window", "label", "token").agg(F.count("*").alias("n"))


def labelled_candidates(docs: DataFrame) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Windows, labels and tokens of :func:`labelled`, all of them, in memory; :func:`scan` leaves them in Spark."""
    rows = labelled(docs).orderBy("window", "label", "token").collect()
    return [bytes(r.window) for r in rows], np.array([r.label for r in rows], np.int64), np.array([r.token for r in rows], np.int64)


def scan(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_net, base, spans`` of each row of ``docs``.

    ``base`` and ``spans`` are comma-joined ``kind:start:end`` (code points, end exclusive) of the patterns' findings
    and of all findings. Null texts count as empty and have none; null ids and repeated rows are kept as they are;
    other columns are not read; an empty table, or one without secrets to learn from, adds nothing to the patterns.
    """
    net = train(labelled(docs), recall=recall)
    log.info("the threshold %.3f keeps %.4f of the held-out secrets", net.threshold, net.recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in balanced(batches, 1):
            texts = batch.column(1).to_pylist()
            base, candidates, windows = [], [], []
            for k, text in enumerate(texts):
                base.append(base_spans(text))
                for m in CANDIDATE.finditer(text):
                    candidates.append((k, *m.span(), len(windows)))
                    windows += [window(text, at, m.end()) for at in window_starts(*m.span())]
            added: list[list[Span]] = [[] for _ in base]
            highest = np.maximum.reduceat(net.scores(windows), [c[3] for c in candidates]).tolist() if candidates else []
            for (k, start, end, _), score in zip(candidates, highest, strict=True):
                if score >= net.threshold and not covered(texts[k], start, end, base[k]):
                    added[k].append((start, end, "net"))
            count = lambda kind, base=base: pa.array([sum(s[2] == kind for s in b) for b in base], pa.int64())
            every = pa.array([joined(in_order(b + a)) for b, a in zip(base, added, strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), count("assign"), count("access"), count("hex"), pa.array(map(len, added), pa.int64()), pa.array(map(joined, base), pa.string()), every],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_net", "base", "spans"],
            )

    read = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return mapped(read, run, "doc_id long, n_assign long, n_access long, n_hex long, n_net long, base string, spans string")
