"""Leaky integrate-and-fire trials: a numpy kernel a trial, as a grouped map over (arm, trial) that yields its spikes as they come."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Membrane:
    """Constants in mV and ms; fixed values of the published model."""

    dt: float = 0.5
    rest: float = -52.0
    reset: float = -52.0
    threshold: float = -45.0
    floor: float = -70.0
    tau_membrane: float = 20.0
    tau_synapse: float = 5.0
    refractory: float = 2.2
    delay: float = 1.8
    w_syn: float = 0.275
    stimulus_factor: float = 250.0


@dataclass(frozen=True)
class Circuit:
    """Edges by sender: offsets (n + 1), targets and weights."""

    offsets: np.ndarray
    targets: np.ndarray
    weights: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def packed(edges: DataFrame) -> DataFrame:
    """``cells, sizes, post, w``: the edges ``pre, post, w`` in the order of (pre, post), an Arrow batch of them a row, at 8 bytes an edge.

    Blocks are cut from a range partitioning, so no task has all edges. One empty block comes with them: a circuit without edges has a row too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                pre = b.column(0).to_numpy()
                first = np.flatnonzero(np.concatenate([[True], pre[1:] != pre[:-1]]))
                parts = (pre[first].astype(np.int32), np.diff(first, append=len(pre)).astype(np.int32), b.column(1).to_numpy().astype(np.int32), b.column(2).to_numpy().astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], BLOCK)

    rows = edges.select(F.col("pre").cast("long"), F.col("post").cast("long"), F.col("w").cast("double")).repartitionByRange("pre", "post").sortWithinPartitions("pre", "post")
    return rows.mapInArrow(run, ", ".join(f"{c} binary" for c in BLOCK)).union(edges.sparkSession.range(1).select(*[F.lit(b"").alias(c) for c in BLOCK]))


BLOCK = ["cells", "sizes", "post", "w"]


def assembled(blocks: list[tuple[bytes, bytes, bytes, bytes]], n: int) -> Circuit:
    """The circuit of all blocks of :func:`packed`, in whatever order they come."""
    read = [tuple(np.frombuffer(x, t) for x, t in zip(b, (np.int32, np.int32, np.int32, np.float32), strict=True)) for b in blocks if len(b[0])]
    read.sort(key=lambda b: (b[0][0], b[2][0], b[0][-1], b[2][-1]))
    cells, sizes, post, w = [np.concatenate([np.zeros(0, t), *(b[k] for b in read)]).astype(t, copy=False) for k, t in enumerate((np.int32, np.int32, np.int32, np.float32))]
    offsets = np.zeros(n + 1, dtype=np.int64)
    np.add.at(offsets, cells.astype(np.int64) + 1, sizes)
    return Circuit(np.cumsum(offsets), post, w)


@dataclass(frozen=True)
class CircuitTable:
    """A circuit of any size as a table of :func:`packed` edges, which never comes to the driver: each trial's task gets its blocks by a shuffle."""

    blocks: DataFrame
    n: int

    def gathered(self) -> Circuit:
        """The circuit on the driver, for small ones."""
        return assembled([tuple(map(bytes, r)) for r in self.blocks.collect()], self.n)

    @property
    def targets(self) -> np.ndarray:
        """Targets by sender, gathered (:meth:`gathered`)."""
        return self.gathered().targets


def circuit_of(edges: DataFrame, n: int, most_edges: int = 8_000_000) -> Circuit:
    """The circuit of ``pre, post, w`` with dense indices under n, for broadcast to the trials.

    It is refused above ``most_edges`` (64 MB), so what is sent has a checked size. Larger circuits stay tables: see :class:`CircuitTable`.
    """
    size = edges.count()
    if size > most_edges:
        raise ValueError(f"{size} edges are too many to broadcast (at most {most_edges}); make a CircuitTable of them, or decimate the graph first")
    return CircuitTable(packed(edges), n).gathered()


def stream_of(*key: object) -> np.random.Generator:
    """A random stream of a key; what isn't in the key shares the stream."""
    return np.random.Generator(np.random.Philox(key=int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest(), 16)))


class Network:
    """State of one trial; all cells a step at once."""

    def __init__(self, circuit: Circuit, m: Membrane = Membrane(), ready: np.ndarray | None = None) -> None:  # noqa: B008
        """``ready``: cells without a refractory time."""
        self.c, self.m = circuit, m
        self.refractory = np.full(circuit.n, m.refractory, dtype=np.float32)
        if ready is not None:
            self.refractory[ready] = 0
        n = circuit.n
        self.v = np.full(n, m.rest, dtype=np.float32)
        self.g = np.zeros(n, dtype=np.float32)
        self.wait = np.zeros(n, dtype=np.float32)
        self.due = np.zeros((max(1, round(m.delay / m.dt)), n), dtype=np.float32)
        self.slot = 0
        self.decay = np.float32(math.exp(-m.dt / m.tau_synapse))

    def inject(self, cells: np.ndarray, weight: float | np.ndarray) -> None:
        np.add.at(self.g, cells, np.float32(weight))

    def step(self) -> np.ndarray:
        """Advances by dt; the cells that fired. A refractory cell keeps its conductance; firing clears it."""
        m = self.m
        self.g += self.due[self.slot]
        self.due[self.slot] = 0
        still = self.wait > 0
        self.wait[still] -= np.float32(m.dt)
        v = self.v + np.float32(m.dt / m.tau_membrane) * (np.float32(m.rest) - self.v + self.g)
        fires = ~still & (v > m.threshold)
        rests = ~still & ~fires
        self.v[rests] = np.maximum(v[rests], np.float32(m.floor))
        self.g[rests] *= self.decay
        self.v[fires], self.g[fires], self.wait[fires] = m.reset, 0, self.refractory[fires]
        fired = np.flatnonzero(fires)
        if len(fired):
            edges = int((self.c.offsets[fired + 1] - self.c.offsets[fired]).sum())
            for some in np.array_split(fired, 1 + edges // 1_000_000):  # so that a volley of all cells takes no more memory than the circuit
                first, last = self.c.offsets[some], self.c.offsets[some + 1]
                size = last - first
                at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                np.add.at(self.due[self.slot], self.c.targets[at].astype(np.intp, copy=False), self.c.weights[at])
        self.slot = (self.slot + 1) % len(self.due)
        return fired


@dataclass
class Loop:
    """Steering feedback: a bin's left-right difference a cell, its slow mean taken off, smoothed, scaled and clamped, turns the heading."""

    gain: float = 1.0
    slow: float = 0.03
    smooth: float = 0.1
    level: float = 0.0
    turn: float = 0.0
    heading: float = 0.0

    def update(self, asymmetry: float, seconds: float) -> float:
        self.level += self.slow * (asymmetry - self.level)
        self.turn += self.smooth * (asymmetry - self.level - self.turn)
        self.heading += max(-1.0, min(1.0, self.gain * self.turn)) * seconds
        return self.heading


#: Fixed values of the rotation drive: a cell's level without its preferred rotation.
YAW_BASELINE = 0.12


def run_trials(
    plan: DataFrame, circuit: Circuit | CircuitTable, pool: np.ndarray, seconds: float, seed: str = "lif", max_hz: float = 150.0, resting: float = 0.0, membrane: Membrane = Membrane(), loop_sides: tuple[np.ndarray, np.ndarray] | None = None, loop_bin: int = 20,  # noqa: B008
    second: np.ndarray | None = None, second_hz: float = 0.0, pools: dict[str, np.ndarray] | None = None, resting_events: float | None = None, always_ready: bool = False, preferred: np.ndarray | None = None,
) -> DataFrame:
    """``arm, trial, neuron, t`` (ms): spikes of a trial for each row of ``plan``; with negative neurons, -1 - cell, the injected events of the pool.

    ``plan``: ``arm, trial, drive`` (level of the pool's stimulation, 0 to 1), ``patch`` (share of the pool that sees
    none), ``kappa`` (scale of all weights), ``gain`` (of the closed loop, 0: open), and, where asked for, a level for each of the ``pools``, and ``yaw``. The random stream of a trial has
    no arm in its key: arms of a trial see the same draws. ``second``: a second pool, stimulated at its own
    rate ``second_hz``, whatever the plan's drive and patch. ``pools``: further ones by name, each at ``max_hz`` times the plan's column of that name. Each has a stream of its own.
    ``preferred``: the pool's cells' signs of rotation; a cell's level is then the baseline and what of ``yaw`` it prefers, in place of ``drive``.
    ``resting``: events a second of every cell, of the weight ``resting_events`` times one synapse (a stimulus's if None). ``always_ready``: stimulated cells have no
    refractory time, as targets of Poisson input in the published model. Trials are independent tasks. A :class:`Circuit` goes out once,
    by broadcast; the blocks of a :class:`CircuitTable` are dealt to each trial's task by a shuffle, trials times the circuit. A task holds one circuit, and yields spikes as they come.
    """
    more = dict(sorted((pools or {}).items()))
    small = circuit if isinstance(circuit, Circuit) else None
    n = circuit.n
    sent = plan.sparkSession.sparkContext.broadcast((small, pool, loop_sides, second, more, preferred))
    columns = ["drive", "patch", "kappa", "gain", *more, *(["yaw"] if preferred is not None else [])]

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, cells, sides, others, more, preferred = sent.value
        blocks, keys = [], None
        for b in batches:
            if not b.num_rows:
                continue
            keys = keys or (b.column(0)[0], b.column(1)[0], b.column(2)[0].as_py())
            if c is None:
                blocks += zip(*[b.column(k).to_pylist() for k in range(3, 3 + len(BLOCK))], strict=True)
        if c is None:
            c = assembled(blocks, n)
            blocks.clear()
        arm, trial, runs = keys
        out: list[tuple[np.ndarray, float]] = []

        def rows() -> pa.RecordBatch:
            size = [len(f) for f, _ in out]
            columns = [pa.repeat(arm, sum(size)), pa.repeat(trial, sum(size)), pa.array(np.concatenate([f for f, _ in out]).astype(np.int64)), pa.array(np.repeat([t for _, t in out], size))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["arm", "trial", "neuron", "t"])

        for row in runs:
            stimulated = np.unique(np.concatenate([cells, *([] if others is None else [others]), *more.values()]))
            net = Network(Circuit(c.offsets, c.targets, c.weights * np.float32(row["kappa"])), membrane, stimulated if always_ready else None)
            streams = {name: stream_of(seed, *([name] if name else []), trial.as_py()) for name in ("", "rest", "second", *more)}
            covered = cells[: round(row["patch"] * len(cells))]
            seen = ~np.isin(cells, covered)
            chance = max_hz * membrane.dt / 1000
            weight = membrane.w_syn * membrane.stimulus_factor
            tone = weight if resting_events is None else membrane.w_syn * resting_events
            loop, sums, held = Loop(row["gain"]), np.zeros(2), 0
            closed = bool(row["gain"] and sides)
            for s in range(round(seconds * 1000 / membrane.dt)):
                level = row["drive"]
                if preferred is not None:
                    level = YAW_BASELINE + (1 - YAW_BASELINE) * np.maximum(0, preferred * row["yaw"])
                if closed:
                    level = max(0.0, min(1.0, row["drive"] - loop.heading))
                hit = cells[(streams[""].random(len(cells)) < chance * level) & seen]
                net.inject(hit, weight)
                if len(hit):
                    out.append((-1 - hit, s * membrane.dt))
                if others is not None and second_hz:
                    net.inject(others[streams["second"].random(len(others)) < second_hz * membrane.dt / 1000], weight)
                for name, of in more.items():
                    if row[name] > 0:
                        net.inject(of[streams[name].random(len(of)) < chance * row[name]], weight)
                if resting:
                    net.inject(np.flatnonzero(streams["rest"].random(c.n) < resting * membrane.dt / 1000), tone)
                fired = net.step()
                if len(fired):
                    out.append((fired, s * membrane.dt))
                if closed:
                    sums += [np.isin(fired, x).sum() for x in sides]
                    if (s + 1) % loop_bin == 0:
                        loop.update(float(sums[1] - sums[0]) / max(1, sum(map(len, sides))), loop_bin * membrane.dt / 1000)
                        sums[:] = 0
                held += len(hit) + len(fired)
                if held > 200_000:
                    yield rows()
                    held = 0
        if out:
            yield rows()

    run = F.struct(*[F.col(c).cast("double").alias(c) for c in columns])
    rows = plan.groupBy("arm", F.col("trial").cast("long").alias("trial")).agg(F.collect_list(run).alias("runs"))  # a row a trial
    if small is None:
        rows = circuit.blocks.crossJoin(F.broadcast(rows)).select(*rows.columns, *BLOCK)
    dealt = rows.repartition(min(1000, 4 * plan.count() + 1), "arm", "trial")  # a number that adaptive plans leave alone: few rows, long tasks
    return dealt.groupBy("arm", "trial").applyInArrow(one, "arm string, trial long, neuron long, t double")


def spikes_only(events: DataFrame) -> DataFrame:
    """:func:`run_trials` without the injected events."""
    return events.filter("neuron >= 0")


def population_rates(spikes: DataFrame, of: DataFrame, by: list[str], seconds: float) -> DataFrame:
    """``by, population, cells, active, rate_hz`` for all populations of ``of`` (``neuron, population``) in each group of spikes; silent ones are 0."""
    counts = spikes.groupBy(*by, "neuron").agg(F.count(F.lit(1)).alias("n")).join(of, "neuron").groupBy(*by, "population").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("fired"))
    sizes = of.groupBy("population").agg(F.count(F.lit(1)).alias("cells"))
    every = spikes.select(*by).distinct().withColumn("_k", F.lit(1)).join(F.broadcast(sizes.withColumn("_k", F.lit(1))), "_k").drop("_k")  # a row a group and population
    out = every.join(counts, [*by, "population"], "left")
    return out.select(*by, "population", "cells", (F.coalesce("fired", F.lit(0)) / F.col("cells")).alias("active"), (F.coalesce("n", F.lit(0)) / (F.col("cells") * F.lit(float(seconds)))).alias("rate_hz"))


def input_conductances(spikes: DataFrame, edges: DataFrame, of: DataFrame, by: list[str], seconds: float, tau_s: float = 0.005) -> DataFrame:
    """``by, population, exc, inh``: mean conductance (mV) that a cell of a population receives: weight times sender's rate times the synapse's time constant."""
    into = edges.join(of.select(F.col("neuron").alias("post"), "population"), "post").groupBy("pre", "population")
    sent = into.agg(F.sum(F.when(F.col("w") > 0, F.col("w")).otherwise(0.0)).alias("e"), F.sum(F.when(F.col("w") < 0, F.col("w")).otherwise(0.0)).alias("i"))
    per = spikes.groupBy(*by, F.col("neuron").alias("pre")).agg((F.count(F.lit(1)) / F.lit(float(seconds))).alias("hz")).join(sent, "pre")
    sizes = of.groupBy("population").agg(F.count(F.lit(1)).alias("cells"))
    got = per.groupBy(*by, "population").agg(F.sum(F.col("hz") * F.col("e")).alias("e"), F.sum(F.col("hz") * F.col("i")).alias("i")).join(F.broadcast(sizes), "population")
    return got.select(*by, "population", (F.col("e") * tau_s / F.col("cells")).alias("exc"), (F.col("i") * tau_s / F.col("cells")).alias("inh"))
