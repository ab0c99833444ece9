"""Operator 9: language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time. It reads runs of letters (A-Z lower-case,
other ASCII characters part the runs) as byte sequences in both directions, labels every byte position
with language probabilities, and a document's probabilities are the mean over all its positions. State
starts anew with each run, so the sum over a run's positions is a function of the run alone: a worker
keeps it for runs that repeat, and whole texts of any length are read in bounded memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map

HIDDEN, LONGEST, BATCH, EPOCHS, RATE, SEED = 16, 32, 512, 3, 0.012, 11
#: Bounds of the training sample: documents of each language, and distinct runs of each language.
DOCS, RUNS = 300, 12_000
#: Most languages that are learned (the most frequent ones), and runs a worker remembers.
LANGS, MEMORY = 200, 250_000
NONE = "und"

_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in bytes(range(256)).lower())


def runs_of(text: str) -> list[bytes]:
    """Letter runs of a whole text as bytes; longer ones than LONGEST in pieces of it."""
    out = text.encode("utf-8").translate(_LETTERS).split()
    if out and max(map(len, out)) > LONGEST:
        out = [r[i : i + LONGEST] for r in out for i in range(0, len(r), LONGEST)]
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Direction:
    """One gated recurrent layer; the input projection is a table row for each byte."""

    names = ("x", "u", "c")

    def __init__(self, rng, hidden):
        self.h = hidden
        self.x = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.u = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        self.c = np.zeros(hidden, np.float32)

    def forward(self, seq: np.ndarray, keep: bool = False):
        """States (T, B, H) for byte sequences (B, T) of one length."""
        n, h = self.h, np.zeros((len(seq), self.h), np.float32)
        states, tape = [], []
        for t in range(seq.shape[1]):
            pre, rec = self.x[seq[:, t]], h @ self.u
            gates = _sigmoid(pre[:, : 2 * n] + rec[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            inner = rec[:, 2 * n :] + self.c
            new = np.tanh(pre[:, 2 * n :] + r * inner)
            if keep:
                tape.append((h, z, r, inner, new))
            h = new + z * (h - new)
            states.append(h)
        return np.stack(states), tape

    def backward(self, seq, tape, grads):
        """Gradients of the parameters from those of all states (T, B, H)."""
        n = self.h
        gx, gu, gc = np.zeros_like(self.x), np.zeros_like(self.u), np.zeros_like(self.c)
        carry = np.zeros_like(grads[0])
        for t in range(len(tape) - 1, -1, -1):
            h, z, r, inner, new = tape[t]
            d = grads[t] + carry
            dnew = d * (1 - z) * (1 - new * new)
            dz = d * (h - new) * z * (1 - z)
            dr = dnew * inner * r * (1 - r)
            drec = np.concatenate([dz, dr, dnew * r], axis=1)
            np.add.at(gx, seq[:, t], np.concatenate([dz, dr, dnew], axis=1))
            gu += h.T @ drec
            gc += drec[:, 2 * n :].sum(0)
            carry = d * z + drec @ self.u.T
        return {"x": gx, "u": gu, "c": gc}


class Network:
    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.langs, self.seed = langs, seed
        self.ahead, self.back = Direction(rng, hidden), Direction(rng, hidden)
        self.out = rng.normal(0, 0.1, (2 * hidden, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def positions(self, seq: np.ndarray, keep: bool = False):
        """Probabilities (T, B, languages) of every position."""
        a, ta = self.ahead.forward(seq, keep)
        b, tb = self.back.forward(seq[:, ::-1], keep)
        states = np.concatenate([a, b[::-1]], axis=2)
        logits = states @ self.out + self.bias
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        return p, (states, ta, tb)

    def step(self, seq, lang, weight):
        """Gradients of the weighted mean cross-entropy over all positions."""
        p, (states, ta, tb) = self.positions(seq, True)
        d = p.copy()
        d[:, np.arange(len(seq)), lang] -= 1
        d *= (weight / (weight.sum() * seq.shape[1]))[None, :, None]
        flat = d.reshape(-1, d.shape[2])
        ds = d @ self.out.T
        n = self.ahead.h
        return {
            "out": states.reshape(-1, states.shape[2]).T @ flat,
            "bias": flat.sum(0),
            "ahead": self.ahead.backward(seq, ta, ds[:, :, :n]),
            "back": self.back.backward(seq[:, ::-1], tb, ds[::-1, :, n:]),
        }

    def train(self, rows: list[tuple[bytes, int, float]], epochs: int = EPOCHS):
        """Adam over batches of one length each; rows: bytes, language number, weight."""
        rng = np.random.default_rng(self.seed)
        by: dict[int, list] = {}
        for row in sorted(rows):
            by.setdefault(len(row[0]), []).append(row)
        batches = []
        for n, own in sorted(by.items()):
            own = [own[i] for i in rng.permutation(len(own))]
            for i in range(0, len(own), BATCH):
                part = own[i : i + BATCH]
                seq = np.frombuffer(b"".join(r[0] for r in part), np.uint8).reshape(len(part), n)
                batches.append((seq, np.array([r[1] for r in part]), np.array([r[2] for r in part], np.float32)))
        where = [(self, "out"), (self, "bias")] + [(d, k) for d in (self.ahead, self.back) for k in Direction.names]
        moments = [(np.zeros_like(getattr(o, k)), np.zeros_like(getattr(o, k))) for o, k in where]
        t, total = 0, epochs * len(batches)
        for _ in range(epochs):
            for i in rng.permutation(len(batches)):
                g = self.step(*batches[i])
                flat = [g["out"], g["bias"], *g["ahead"].values(), *g["back"].values()]
                t += 1
                rate = RATE * (1 - 0.9 * t / total)
                for (o, k), grad, (m, v) in zip(where, flat, moments):
                    m += 0.1 * (grad - m)
                    v += 0.01 * (grad * grad - v)
                    getattr(o, k)[...] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return self


@dataclass
class Pooler:
    """Sums of position probabilities for runs, remembered up to MEMORY runs; one in each worker."""

    net: Network

    def __post_init__(self):
        self._empty()

    def _empty(self):
        self.row: dict[bytes, int] = {}
        self.sums = np.zeros((1 << 14, len(self.net.langs)), np.float32)

    def learn(self, runs: set[bytes]) -> None:
        """Read the runs that are not known yet."""
        if len(self.row) > MEMORY:
            self._empty()
        by: dict[int, list[bytes]] = {}
        for r in runs - self.row.keys():
            by.setdefault(len(r), []).append(r)
        for n, own in by.items():
            for i in range(0, len(own), 4096):
                part = own[i : i + 4096]
                p, _ = self.net.positions(np.frombuffer(b"".join(part), np.uint8).reshape(len(part), n))
                first = len(self.row)
                while first + len(part) > len(self.sums):
                    self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
                self.sums[first : first + len(part)] = p.sum(axis=0)
                self.row.update(zip(part, range(first, first + len(part))))

    def document(self, runs: list[bytes]) -> tuple[str, float]:
        rows = np.fromiter(map(self.row.__getitem__, runs), np.int64, len(runs))
        mean = self.sums[rows].sum(axis=0, dtype=np.float64) / sum(map(len, runs))
        k = int(mean.argmax())
        return self.net.langs[k], float(min(1.0, mean[k]))


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_network(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """Train on a bounded sample of the labelled rows outside the held-out third; None if there is none.

    At most DOCS documents of each of at most LANGS languages, the first by a hash of the key, and of
    their whole texts at most RUNS distinct letter runs of each language, again by hash.
    """
    own = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key)).select(key, lang)
    most = own.groupBy(lang).agg(F.count("*").alias("n")).orderBy(F.desc("n"), lang).limit(LANGS)
    order = Window.partitionBy(lang).orderBy(F.xxhash64(key), key)
    picked = own.join(F.broadcast(most.select(lang)), lang).withColumn("k", F.row_number().over(order)).where(f"k <= {DOCS}")
    # at most DOCS * LANGS keys: small enough to send to every executor
    sample = docs.select(key, text, lang).join(F.broadcast(picked.select(key, lang).distinct()), [key, lang])

    def make():
        def each(row):
            count: dict[bytes, int] = {}
            for r in runs_of(row[text] or ""):
                count[r] = count.get(r, 0) + 1
            for r, n in count.items():
                yield row[lang], r, n

        return each

    runs = arrow_map(sample, make, "lang string, run binary, n bigint").groupBy("lang", "run").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("run"), "run")
    rows = runs.withColumn("k", F.row_number().over(order)).where(f"k <= {RUNS}").select("lang", "run", "n").collect()
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    number = {x: i for i, x in enumerate(langs)}
    return Network(langs).train([(bytes(r["run"]), number[r["lang"]], float(min(r["n"], 50)) ** 0.5) for r in rows])


def identify_languages(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, lang_pred and score (mean probability) for each row of ``docs``.

    A text that is null or has no letter is 'und' with score 0, as are all texts without a network.
    Only the text is read for a prediction. Repeated rows and null keys (never held out) give a row each.
    """
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        pool = Pooler(sent.value) if sent.value else None
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                end, size, texts = start, 0, []
                while end < batch.num_rows and size < 1_000_000:
                    texts.append(batch.column(1)[end].as_py())
                    size += len(texts[-1] or "")
                    end += 1
                runs = [runs_of(t) if pool and has_letter(t) else [] for t in texts]
                if pool:
                    pool.learn(set().union(*runs))
                out = [pool.document(r) if r else (NONE, 0.0) for r in runs]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())],
                    names=[key, "lang_pred", "score"],
                )
                start = end

    found = docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")
    return found.select(key, held_out(key).alias("held_out"), "lang_pred", "score")
