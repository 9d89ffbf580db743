"""Secret scans: fixed patterns, and a character network over every candidate and what surrounds it.

Candidates of a text: the matches of three patterns (assignments, access keys, hexadecimal runs), and every other run of
key characters of ``LEAST`` or more that holds a letter and a digit and touches no match. A convolutional network in
numpy reads each with ``AROUND`` bytes on either side; a long candidate is read whole, in windows, and its best one counts.

The network learns from findings that the patterns label: 1 for assignments and access keys with a letter and a digit in the
value and for hexadecimal runs with both; 0 for runs of digits alone, assignments of short values, and a share of long
plain words. Each is seen with its surroundings and without, so that a value is known by its form where no keyword names it.
All findings with different windows take part; a quarter of them is held back. The others are dealt over parts of about
``PART``: each part goes on from the common network for a round, and the mean of the parts' networks is the next common one. On the
quarter the logits, counted in steps of 1/``STEPS``, are calibrated (a logistic curve), and each kind gets a threshold that finds ``RECALL`` of its labelled
secrets with the fewest other findings, halfway to the best of those it leaves out (all kinds together for a kind with none).

Matches of the patterns are always reported; a further candidate is reported as ``net`` where it reaches its threshold.

Texts are read once: the candidates, with their windows, go to the shared folder; training and scoring read them from there.
Only the labelled findings are shuffled. Defined results: a null or empty text has no span, null ids stay null, repeated rows are reported each,
an empty table gives no rows; without a labelled finding of either label nothing is added and ``score`` is null.
Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from querygauge.llm.byte_runs import byte_set, joined, runs
from querygauge.llm.common import slices, text_or_empty
from querygauge.session import scratch_path

#: Fixed values of the patterns.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)  # of bytes: ASCII letters only
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "net")  # in the order of spans that start together
_WORD = 4  # candidates that only teach: plain words, and assignments of short values
_SHORT = 5

KEY_BYTE = byte_set("AZaz09++//__..==--")
HEX_BYTE = byte_set("09af")
DIGIT, PLAIN = byte_set("09"), byte_set("AZaz")

LEAST = 16  # shortest further candidate
AROUND, INSIDE = 24, 48  # bytes of a window before and behind, and of the candidate
WIDTH = 2 * AROUND + INSIDE
PART = 3000  # labelled findings that one part learns from in a round
ROUNDS = 4
STEPS = 1000  # of a logit, in which those of the findings held back are counted
WORD_SHARE = 64  # one plain word in so many is kept as an example
RECALL = 0.98


# --- candidates ---------------------------------------------------------------------------------


def _spans(data: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, label) of all candidates in the bytes of texts that line feeds part; label -1 is unknown."""
    raw, out = data.tobytes(), []
    digits, letters = (np.concatenate([[0], np.cumsum(x[data])]) for x in (DIGIT, PLAIN))
    mixed = lambda s, e: bool(digits[e] > digits[s] and letters[e] > letters[s])
    for m in ASSIGN.finditer(raw):
        long_enough = m.end(2) - m.start(2) >= LEAST_VALUE
        out.append((m.start(), m.end(), 0 if long_enough else _SHORT, 0 if not long_enough else 1 if mixed(*m.span(2)) else -1))
    out += [(m.start(), m.end(), 1, 1 if mixed(*m.span()) else -1) for m in ACCESS.finditer(raw) if m.end() - m.start() >= LEAST_ACCESS]
    first, last = runs(HEX_BYTE[data])
    for s, e in zip(first[last - first >= LEAST_HEX].tolist(), last[last - first >= LEAST_HEX].tolist()):
        out.append((s, e, 2, 1 if mixed(s, e) else 0 if letters[e] == letters[s] else -1))
    first, last = runs(KEY_BYTE[data])
    long_enough = last - first >= LEAST_VALUE
    first, last = first[long_enough], last[long_enough]
    base = sorted((s, e) for s, e, kind, _ in out if kind < 3)
    starts, ends = np.array([s for s, _ in base] or [0]), np.maximum.accumulate(np.array([e for _, e in base] or [0]))
    before = np.searchsorted(starts, last, side="left") - 1  # the last match that starts before the run's end
    free = (before < 0) | (ends[np.maximum(before, 0)] <= first)
    n_digits, n_letters = digits[last] - digits[first], letters[last] - letters[first]
    further = free & (last - first >= LEAST) & (n_digits > 0) & (n_letters > 0)
    out += [(s, e, 3, -1) for s, e in zip(first[further].tolist(), last[further].tolist())]
    plain = free & (n_letters == last - first)
    for s, e in zip(first[plain].tolist(), last[plain].tolist()):
        if hashlib.blake2b(raw[s:e], digest_size=2).digest()[0] % WORD_SHARE == 0:
            out.append((s, e, _WORD, 0))
    return sorted(out, key=lambda x: (x[0], x[2]))


def _windows(data: bytes, low: int, high: int, start: int, end: int) -> bytes:
    """Candidate and surroundings inside its text, one window of ``WIDTH`` bytes for every ``INSIDE`` bytes of it; 0 fills up."""
    out = []
    for at in range(start, end, INSIDE):
        stop = min(at + INSIDE, end)
        out.append(data[max(low, at - AROUND) : at].rjust(AROUND, b"\0") + data[at:stop].ljust(INSIDE, b"\0") + data[stop : min(high, stop + AROUND)].ljust(AROUND, b"\0"))
    return b"".join(out)


_CANDIDATE = "ARRAY<STRUCT<kind: INT, start: BIGINT, stop: BIGINT, label: INT, windows: BINARY>>"
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("label", pa.int32()), ("windows", pa.binary())]))


def candidates(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """(doc_id, found) of every row; starts and ends in code points."""

    def find(batches):
        for batch in batches:
            for at, part in slices(batch.column(1)):
                starts, data = joined(part)
                places = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                raw, found = data.tobytes(), [[] for _ in range(len(part))]
                spans = _spans(data)
                owner = np.searchsorted(starts, [s[0] for s in spans], side="right") - 1
                for (s, e, kind, label), doc in zip(spans, owner.tolist()):
                    low, high = int(starts[doc]), int(starts[doc + 1]) - 1
                    found[doc].append({"kind": kind, "start": int(places[s] - places[low]), "stop": int(places[e] - places[low]), "label": label, "windows": _windows(raw, low, high, s, e)})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(found, _ARROW)], names=["doc_id", "found"])

    rows = docs.select(doc_id.alias("doc_id"), text_or_empty(text).alias("t"))
    return rows.mapInArrow(find, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, found {_CANDIDATE}")


# --- the network --------------------------------------------------------------------------------

CODES = np.where((np.arange(256) >= 32) & (np.arange(256) < 127), np.arange(256) - 31, 96)
CODES[0] = 0
_REACH, _FILTERS, _SIZE = 5, 24, 8
_ROWS = 256  # windows read at once


@dataclass
class Network:
    """Characters to vectors, one convolution, largest and mean answer of each filter, one logit."""

    letters: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    last: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        wide = _REACH * (_SIZE + 1)
        return cls(r.normal(0, 0.3, (97, _SIZE)), r.normal(0, wide**-0.5, (wide, _FILTERS)), np.zeros(_FILTERS), r.normal(0, 0.1, 2 * _FILTERS), np.zeros(1))

    def _forward(self, codes: np.ndarray):
        mark = np.zeros((*codes.shape, 1))
        mark[:, AROUND : AROUND + INSIDE] = 1.0  # which bytes belong to the candidate
        x = np.concatenate([self.letters[codes], mark], axis=2)
        n = codes.shape[1] - _REACH + 1
        columns = np.concatenate([x[:, i : i + n] for i in range(_REACH)], axis=2)
        h = np.maximum(columns @ self.filters + self.bias, 0)
        top = h.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None], axis=1)[:, 0], h.mean(axis=1)], axis=1)
        return columns, h, top, pooled, pooled @ self.out + self.last[0]

    def logits(self, codes: np.ndarray) -> np.ndarray:
        parts = [self._forward(codes[i : i + _ROWS])[-1] for i in range(0, len(codes), _ROWS)]
        return np.concatenate([np.zeros(0), *parts])

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean logistic loss, in the order of the fields."""
        columns, h, top, pooled, z = self._forward(codes)
        dz = (1 / (1 + np.exp(-z)) - labels) / len(labels)
        d_pooled = dz[:, None] * self.out
        dh = np.repeat(d_pooled[:, None, _FILTERS:] / h.shape[1], h.shape[1], axis=1)
        rows, filters = np.indices(top.shape)
        dh[rows, top, filters] += d_pooled[:, :_FILTERS]
        dh *= h > 0
        d_columns = dh @ self.filters.T
        d_letters, n = np.zeros_like(self.letters), h.shape[1]
        for i in range(_REACH):
            np.add.at(d_letters, codes[:, i : i + n], d_columns[:, :, i * (_SIZE + 1) : i * (_SIZE + 1) + _SIZE])
        wide = columns.shape[2]
        return [d_letters, columns.reshape(-1, wide).T @ dh.reshape(-1, _FILTERS), dh.sum(axis=(0, 1)), dz @ pooled, np.array([dz.sum()])]

    def fit(self, codes: np.ndarray, labels: np.ndarray, moments: tuple[list, list], step: float, turn: int, batch: int = 64, rate: float = 0.01, seed: int = 7) -> float:
        """One round of Adam over shuffled batches, from the given moments and step on; the same rows give the same network."""
        weights, r = [self.letters, self.filters, self.bias, self.out, self.last], np.random.default_rng(seed)
        order = [r.permutation(len(labels)) for _ in range(turn + 1)][turn]
        for i in range(0, len(order), batch):
            step += 1
            rows = order[i : i + batch]
            for w, g, m, v in zip(weights, self.gradients(codes[rows], labels[rows]), *moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return step

    def state(self, moments: tuple[list, list], step: float) -> np.ndarray:
        return np.concatenate([x.ravel() for x in [self.letters, self.filters, self.bias, self.out, self.last, *moments[0], *moments[1]]] + [[step]])

    @classmethod
    def of_state(cls, state: np.ndarray) -> tuple[Network, tuple[list, list], float]:
        plain, out, at = cls.fresh(), [], 0
        for w in [plain.letters, plain.filters, plain.bias, plain.out, plain.last] * 3:
            out.append(state[at : at + w.size].reshape(w.shape).copy())
            at += w.size
        return cls(*out[:5]), (out[5:10], out[10:]), float(state[-1])


@dataclass
class Scanner:
    network: Network
    slope: float
    shift: float
    thresholds: tuple[float, ...]  # of KINDS

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.network.logits(codes) + self.shift)))


def _codes(windows: bytes) -> np.ndarray:
    return CODES[np.frombuffer(windows, dtype=np.uint8)].reshape(-1, WIDTH)


def alone(codes: np.ndarray) -> np.ndarray:
    """The same windows without what surrounds the candidate."""
    out = codes.copy()
    out[:, :AROUND] = 0
    out[:, AROUND + INSIDE :] = 0
    return out


def _calibrated(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve by Newton steps, each logit ``n`` times; a little ridge keeps parted classes finite."""
    w = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + 1e-2 * (w - [1.0, 0.0])
        w = w - np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), gradient)
    return float(max(w[0], 1e-3)), float(w[1])


def _round(state: np.ndarray, turn: int):
    """A part's findings to the state of the network that a round over them gives."""

    def learn(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["label"].to_pylist(), table["h"].to_pylist(), table["w"].to_pylist()))
        codes, labels = np.concatenate([_codes(w) for _, _, w in rows]), np.array([label for label, _, _ in rows], dtype=float)
        network, moments, step = Network.of_state(state)
        step = network.fit(np.concatenate([codes, alone(codes)]), np.tile(labels, 2), moments, step, turn)
        return pa.table({"part": table["part"].slice(0, 1), "n": pa.array([len(rows)], pa.int64()), "state": pa.array([network.state(moments, step).tobytes()], pa.binary())})

    return learn


def _judge(network: Network):
    def judge(batches):
        for batch in batches:
            if batch.num_rows:
                codes = np.concatenate([_codes(w.as_py()) for w in batch.column("w")])
                z = np.concatenate([network.logits(codes), network.logits(alone(codes))])
                twice = [np.tile(batch.column(c).to_numpy(), 2) for c in ("kind", "label")]
                yield pa.RecordBatch.from_arrays([pa.array(twice[0], pa.int32()), pa.array(twice[1], pa.int32()), pa.array(z)], ["kind", "label", "z"])

    return judge


def labelled(found: DataFrame) -> DataFrame:
    """(label, w, kind, h) of all labelled findings with different windows, written to the shared folder."""
    spark = found.sparkSession
    one = found.select(F.explode("found").alias("f")).filter("f.label >= 0").select("f.kind", "f.label", F.substring("f.windows", 1, WIDTH).alias("w"))
    different = one.groupBy("label", "w").agg(F.min("kind").alias("kind")).withColumn("h", F.xxhash64("w"))
    folder = scratch_path(spark, "labelled")
    different.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "h").write.parquet(folder)
    return spark.read.parquet(folder)


def train(found: DataFrame, part: int = PART, recall: float = RECALL) -> Scanner | None:
    """Network, calibration and thresholds from all labelled findings; None without both labels."""
    rows = labelled(found).withColumn("held", F.pmod("h", F.lit(4)) == 0)
    n = {(r["held"], r["label"]): r["count"] for r in rows.groupBy("held", "label").count().collect()}
    if not all(n.get((False, label), 0) + n.get((True, label), 0) for label in (0, 1)):
        return None
    hold = all(n.get((held, label), 0) for held in (False, True) for label in (0, 1))  # else too few to hold any back: the curve is fitted on all
    learners, judged = (rows.filter("not held"), rows.filter("held")) if hold else (rows, rows)
    parts = -(-sum(c for (held, _), c in n.items() if not (hold and held)) // part)
    dealt = learners.select("label", "w", "h", F.pmod(F.xxhash64(F.lit(1), "w"), F.lit(parts)).cast("int").alias("part")).repartition(parts, "part")
    network = Network.fresh()
    zeros = lambda: [np.zeros_like(w) for w in (network.letters, network.filters, network.bias, network.out, network.last)]
    state = network.state((zeros(), zeros()), 0)
    for turn in range(ROUNDS):
        states = sorted(dealt.groupBy("part").applyInArrow(_round(state, turn), "part int, n long, state binary").collect())
        total = sum(r["n"] for r in states)
        state = sum(np.frombuffer(bytes(r["state"])) * (r["n"] / total) for r in states)
    network, _, _ = Network.of_state(state)
    # a step's logits count as their mean: bounded in number, and exact where a step holds one
    logits = judged.select("kind", "label", "w").mapInArrow(_judge(network), "kind int, label int, z double")
    counts = logits.groupBy("kind", "label", F.floor(F.col("z") * STEPS).alias("step")).agg(F.count("*"), F.avg("z"), F.min("z")).drop("step").collect()
    kind_of, y, times, z, least = np.array([list(r) for r in counts], dtype=float).T
    positive = y == 1
    slope, shift = _calibrated(z, y, times)
    logit = slope * least + shift
    scanner = Scanner(network, slope, shift, ())

    def threshold(of: np.ndarray) -> float:
        """Halfway, in logits, from the highest score that ``recall`` of the secrets reach to the best other finding below it: no more of the others pass."""
        order = np.argsort(-logit[of])
        reached = np.cumsum(times[of][order])
        top = logit[of][order][np.searchsorted(reached, np.ceil(recall * reached[-1]))]
        below = logit[~positive & (logit < top)]
        return float(1 / (1 + np.exp(-(top + below.max()) / 2))) if len(below) else float(1 / (1 + np.exp(-top)))

    scanner.thresholds = tuple(threshold(positive & (kind_of == k)) if (positive & (kind_of == k)).any() else threshold(positive) for k in range(3)) + (threshold(positive),)
    return scanner


# --- reports ------------------------------------------------------------------------------------


def _report(scanner: Scanner | None):
    fields = pa.schema([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_net", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_confirmed", pa.int64()), ("score", pa.float64())])

    def report(batches):
        for batch in batches:
            found = batch.column(1).to_pylist()
            flat = [(doc, f) for doc, list_ in enumerate(found) for f in list_ if f["kind"] < len(KINDS)]
            best = np.zeros(0)
            if scanner is not None and flat:
                sizes = [len(f["windows"]) // WIDTH for _, f in flat]
                scores = np.concatenate([scanner.scores(_codes(b"".join(f["windows"] for _, f in flat[i : i + 512]))) for i in range(0, len(flat), 512)])
                best = np.maximum.reduceat(scores, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            rows = [{"n_assign": 0, "n_access": 0, "n_hex": 0, "n_net": 0, "n_confirmed": 0, "score": None, "base": [], "all": []} for _ in found]
            for i, (doc, f) in enumerate(flat):
                row, kind, name = rows[doc], f["kind"], KINDS[f["kind"]]
                score = None if scanner is None else float(best[i])
                sure = score is not None and score >= scanner.thresholds[kind]
                if score is not None:
                    row["score"] = score if row["score"] is None else max(row["score"], score)
                if kind == 3 and not sure:
                    continue
                row[f"n_{name}"] += 1
                row["n_confirmed"] += sure
                span = f"{name}:{f['start']}:{f['stop']}"
                row["all"].append(span)
                if kind < 3:
                    row["base"].append(span)
            for row in rows:
                row["base_sha256"] = hashlib.sha256(",".join(row.pop("base")).encode()).hexdigest()
                row["spans"] = ",".join(row.pop("all"))
            table = pa.RecordBatch.from_pylist(rows, schema=fields)
            yield pa.RecordBatch.from_arrays([batch.column(0), *table.columns], names=["doc_id", *fields.names])

    return report


def secret_scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: int = PART, recall: float = RECALL) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_net, base_sha256, spans, n_confirmed, score) of every row.

    ``spans`` are kind:start:stop in code points by start, then kind; ``base_sha256`` is the digest of those of the patterns;
    ``n_confirmed`` counts the spans that the network finds too, ``score`` is the largest probability of a candidate."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "candidates")
    candidates(docs, F.col(doc_id), F.col(text)).write.parquet(folder)
    found = spark.read.parquet(folder)
    kind = found.schema["doc_id"].dataType.simpleString()
    columns = "n_assign BIGINT, n_access BIGINT, n_hex BIGINT, n_net BIGINT, base_sha256 STRING, spans STRING, n_confirmed BIGINT, score DOUBLE"
    return found.mapInArrow(_report(train(found, part, recall)), f"doc_id {kind}, {columns}")

