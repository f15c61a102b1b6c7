"""Blocks of areas: the state of the smoothing model and its graph as arrays.

A block holds about ``ROWS_PER_BLOCK`` neighbouring keys of one model. Its values
lie in arrays, its edges in positions, so that a product with the graph is one sum by
position. Blocks exchange the values at their borders only: a *slot* is a value that
one block owes another. That is the value of one key or, where the receiver has very
many neighbours, their sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# What changes from round to round, one number per row.
VECTORS = ("phi", "theta", "lap", "x", "r", "p", "s", "v")
STATE = ["block", "model", "classes", "sums", *VECTORS]
STATE_SCHEMA = "block int, model int, classes binary, sums binary, " + ", ".join(f"{v} binary" for v in VECTORS)

NUMBERS = ("o", "e", "log_e", "tau2", "sigma2", "n")
FIXED = {
    **dict.fromkeys(NUMBERS, np.float64),
    # Class of each row among ``classes``, place of its key, and what is missing in it.
    "class": np.int32, "key": np.int32, "missing": np.uint8,
    # Edges: the key that receives, and the slot it takes; slots lie in the order of ``senders``.
    "senders": np.int32, "sender_slots": np.int32, "edge_key": np.int32, "edge_slot": np.int32, "edge_times": np.float64,
    # Parts of the slots that the block fills, in the order of ``receivers``.
    "receivers": np.int32, "receiver_slots": np.int32, "part_key": np.int32, "part_slot": np.int32, "part_times": np.float64,
}
FIXED_SCHEMA = "block int, model int, keys int, classes binary, " + ", ".join(f"`{name}` binary" for name in FIXED)
MESSAGES = "block int, sender int, data binary"
# A row without one of its numbers, and one whose logarithm of the expected count is missing.
NO_NUMBER, NO_LOGARITHM = 1, 2

STEP_LENGTHS = (1.0, 0.5, 0.25, 0.125, 0.0625, 0.03125, 0.015625)
OBJECTIVES = tuple(f"objective_{k}" for k in range(len(STEP_LENGTHS) + 1))
# Sums per class that the next decision needs.
SUMS = ("w", "rb", "g_theta", "g_phi", "gap", "ru", "uv", "wu", "phi", "x", *OBJECTIVES)


@dataclass(frozen=True)
class Scalars:
    """What a round needs beside the rows: of each working model whether it moves and its two
    factors; of each class the effects and steps before and after, and its preconditioned residual."""

    models: dict[int, tuple[bool, float, float]]
    classes: np.ndarray  # class x (beta before, xb before, beta, xb, ub)


def _slots(links: pa.Table, receives: bool) -> tuple[np.ndarray, ...]:
    """Blocks at the other end, slots of each, and key, slot and multiplicity (none: all are one) per link."""
    chosen = links.filter(links["receives"] if receives else pa.compute.invert(links["receives"]))
    other, label, key, times = (chosen[c].to_numpy() for c in ("other", "label", "key", "times"))
    order = np.lexsort((key, label, other))
    other, label, key, times = other[order], label[order], key[order], times[order]
    first = np.ones(len(other), bool)
    first[1:] = (other[1:] != other[:-1]) | (label[1:] != label[:-1])
    others, counts = np.unique(other[first], return_counts=True)
    return others, counts, key, np.cumsum(first) - 1, times if (times != 1).any() else times[:0]


def build(rows: pa.Table, links: pa.Table) -> pa.Table:
    """One block as one row of ``FIXED_SCHEMA``, from its rows and its links."""
    if not rows.num_rows:
        return pa.Table.from_pydict({name: [] for name in _names(FIXED_SCHEMA)}, _arrow(FIXED_SCHEMA))
    rows = rows.sort_by("pos")
    classes, place = np.unique(rows["class"].to_numpy(), return_inverse=True)
    found = {name: rows[name].to_numpy(zero_copy_only=False).astype(np.float64) for name in NUMBERS}
    no_number = np.zeros(rows.num_rows, bool)
    for name in ("o", "e", "tau2", "sigma2"):
        no_number |= rows[name].is_null().to_numpy()
    missing = np.where(no_number, NO_NUMBER, 0) | np.where(rows["log_e"].is_null().to_numpy(), NO_LOGARITHM, 0)
    found |= {"class": place, "key": rows["key"].to_numpy(), "missing": missing}
    found |= dict(zip(("senders", "sender_slots", "edge_key", "edge_slot", "edge_times"), _slots(links, True)))
    found |= dict(zip(("receivers", "receiver_slots", "part_key", "part_slot", "part_times"), _slots(links, False)))
    row = {
        "block": rows["block"][0].as_py(), "model": rows["model"][0].as_py(),
        "keys": int(rows["key"].to_numpy().max()) + 1, "classes": classes.astype(np.int32).tobytes(),
    }
    row |= {name: found[name].astype(kind).tobytes() for name, kind in FIXED.items()}
    return pa.Table.from_pylist([row], _arrow(FIXED_SCHEMA))


def _names(schema: str) -> list[str]:
    return [part.split()[0].strip("`") for part in schema.split(", ")]


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[part.split()[1]]) for name, part in zip(_names(schema), schema.split(", "))])


class Block:
    """Arrays of one row of the joined tables, read in place; columns that were not read are not there."""

    def __init__(self, row: dict):
        self.number, self.model, self.keys = row["block"], row["model"], row["keys"]
        self.classes = np.frombuffer(row["classes"], np.int32)
        for name, kind in FIXED.items():
            if name in row:
                setattr(self, name, np.frombuffer(row[name], kind))
        self.state = {name: np.frombuffer(row[name], np.float64) for name in VECTORS if name in row}

    def present(self, values: np.ndarray, kinds: int = NO_NUMBER) -> np.ndarray:
        """Without what is missing, which counts nothing in a sum."""
        lost = self.missing & kinds
        return np.where((lost != 0) & np.isnan(values), 0.0, values) if lost.any() else values

    def step(self, scalars: Scalars) -> np.ndarray:
        """The rows after their model's next move or iteration; their messages."""
        self.moves, first, second = scalars.models[self.model]
        mine = scalars.classes[self.classes]
        beta, xb, self.beta, self.xb, self.ub = (mine[:, k][getattr(self, "class")] for k in range(5))
        now = self.state
        mu = self.e * np.exp(beta + now["phi"] + now["theta"])
        if self.moves:
            gradient = self.o - mu - now["theta"] / self.sigma2
            theta_step = (gradient - mu * (now["x"] + xb)) / (mu + 1 / self.sigma2)
            zero = np.zeros(len(mu))
            now |= {"phi": now["phi"] + first * now["x"] - second, "theta": now["theta"] + first * theta_step}
            now |= {name: zero for name in ("x", "r", "p", "s")}
            self.message = now["phi"]
        else:
            scale = mu / (1 + mu * self.sigma2) + self.n / self.tau2
            p, s = now["r"] / scale + second * now["p"], now["v"] + second * now["s"]
            now |= {"p": p, "s": s, "x": now["x"] + first * p, "r": now["r"] - first * s}
            self.message = now["r"] / scale
        return self.message

    def owed(self) -> dict[int, np.ndarray]:
        """Slots of each block that takes some, its own included."""
        by_key = np.bincount(self.key, self.present(self.message), self.keys)
        parts = by_key[self.part_key]
        if len(self.part_times):
            parts = parts * self.part_times
        slots = np.bincount(self.part_slot, parts, int(self.receiver_slots.sum()))
        return dict(zip(self.receivers.tolist(), np.split(slots, np.cumsum(self.receiver_slots)[:-1])))

    def meet(self, messages: dict[int, np.ndarray]) -> None:
        """The product with the graph, from the slots of all neighbours."""
        slots = np.concatenate([messages[k] for k in self.senders.tolist()] or [np.zeros(0)])
        taken = slots[self.edge_slot]
        if len(self.edge_times):
            taken = taken * self.edge_times
        around = np.bincount(self.edge_key, taken, self.keys)[self.key]
        spread = self.n * self.message - around
        now = self.state
        mu = self.e * np.exp(self.beta + now["phi"] + now["theta"])
        self.weight = mu / (1 + mu * self.sigma2)
        if self.moves:
            theta_gradient = self.o - mu - now["theta"] / self.sigma2
            reduced = self.o - mu - self.weight * self.sigma2 * theta_gradient
            now |= {"lap": spread, "r": reduced - spread / self.tau2, "v": np.zeros(len(mu))}
        else:
            now["v"] = self.weight * (self.message + self.ub) + spread / self.tau2

    def sums(self) -> np.ndarray:
        """Class x ``SUMS``: all that the next decision needs."""
        phi, theta, lap, x, r, v = (self.state[name] for name in ("phi", "theta", "lap", "x", "r", "v"))
        eta = self.beta + phi + theta
        mu, w = self.e * np.exp(eta), self.weight
        u = r / (w + self.n / self.tau2)
        gt = self.o - mu - theta / self.sigma2
        gp = self.o - mu - lap / self.tau2
        rb = self.o - mu - w * self.sigma2 * gt
        theta_step = (gt - mu * (x + self.xb)) / (mu + 1 / self.sigma2)
        # A x = rhs - r, so the Laplacian of x needs no product of its own.
        lap_x = self.tau2 * (rb - lap / self.tau2 - r - w * (x + self.xb))
        parts = [w, rb, gt * gt, gp * gp, self.o - mu, r * u, u * v, w * u, phi, x]
        eta_step = self.xb + x + theta_step
        for t in (0.0, *STEP_LENGTHS):
            there, phi_t, theta_t = eta + t * eta_step, phi + t * x, theta + t * theta_step
            parts.append(
                self.present(
                    self.o * (self.log_e + there) - self.e * np.exp(there)
                    - phi_t * (lap + t * lap_x) / (2 * self.tau2) - theta_t * theta_t / (2 * self.sigma2),
                    NO_NUMBER | NO_LOGARITHM,
                )
            )
        place, size = getattr(self, "class"), len(self.classes)
        return np.stack([np.bincount(place, self.present(part), size) for part in parts], 1)

    def row(self) -> dict:
        return {
            "block": self.number, "model": self.model, "classes": self.classes.tobytes(), "sums": self.sums().tobytes(),
            **{name: self.state[name].tobytes() for name in VECTORS},
        }


# As in Spark, a division by zero is an error; what overflows is infinite.
def _strict():
    return np.errstate(all="ignore", divide="raise")


def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before the first round: all zero."""
    for batch in batches:
        for k in range(batch.num_rows):
            block, model, classes, rows = (batch.column(c)[k].as_py() for c in ("block", "model", "classes", "key"))
            zero = bytes(2 * len(rows))  # eight bytes a row; keys take four
            row = {"block": block, "model": model, "classes": classes, "sums": b"", **dict.fromkeys(VECTORS, zero)}
            yield pa.RecordBatch.from_pylist([row], _arrow(STATE_SCHEMA))


# What a round's messages are made from.
SENT = ["block", "model", "keys", "classes", "o", "e", "tau2", "sigma2", "n", "class", "key", "missing",
        "receivers", "receiver_slots", "part_key", "part_slot", "part_times"]
SENT_STATE = ["phi", "theta", "x", "r", "p", "s", "v"]


def sender(scalars: Scalars) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Slots that blocks owe to other blocks, one row per pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block(batch.slice(k, 1).to_pylist()[0])
                if block.model not in scalars.models:
                    continue
                with _strict():
                    block.step(scalars)
                    owed = [
                        {"block": to, "sender": block.number, "data": data.tobytes()}
                        for to, data in block.owed().items()
                        if to != block.number
                    ]
                yield pa.RecordBatch.from_pylist(owed, _arrow(MESSAGES))

    return run


def receiver(scalars: Scalars) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block after the round, from itself and the messages to it; none of a model that has left."""

    def run(mine: pa.Table, messages: pa.Table) -> pa.Table:
        found = []
        for row in mine.to_pylist():
            block = Block(row)
            if block.model in scalars.models:
                with _strict():
                    block.step(scalars)
                    slots = {k: np.frombuffer(data, np.float64) for k, data in zip(*(messages[c].to_pylist() for c in ("sender", "data")))}
                    own = block.owed().get(block.number)
                    block.meet(slots if own is None else {**slots, block.number: own})
                    found.append(block.row())
        return pa.Table.from_pylist(found, _arrow(STATE_SCHEMA))

    return run


EFFECTS = "block int, pos int, phi double, theta double"


def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``block, pos, phi, theta``: one row per area."""
    for batch in batches:
        for k in range(batch.num_rows):
            number, phi, theta = (batch.column(c)[k].as_py() for c in ("block", "phi", "theta"))
            phi, theta = np.frombuffer(phi, np.float64), np.frombuffer(theta, np.float64)
            columns = [np.full(len(phi), number, np.int32), np.arange(len(phi), dtype=np.int32), phi, theta]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "pos", "phi", "theta"])
