"""Gradients of small networks by a tape: each operation remembers how its inputs take part in its result.

Values are NumPy arrays of a batch; only what the networks of :mod:`tidewatch.operators.nets` need is here.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Value:
    """An array, and what it was made of: (input, how a gradient of this one becomes the input's)."""

    __slots__ = ("grad", "made_of", "of")

    def __init__(self, of: np.ndarray, made_of: tuple[tuple[Value, Callable], ...] = ()):
        self.of, self.made_of, self.grad = np.asarray(of, np.float64), made_of, None

    def __add__(self, other: Value) -> Value:
        return Value(self.of + other.of, ((self, lambda g: _shrunk(g, self.of.shape)), (other, lambda g: _shrunk(g, other.of.shape))))

    def __mul__(self, other: Value) -> Value:
        return Value(self.of * other.of, ((self, lambda g: _shrunk(g * other.of, self.of.shape)), (other, lambda g: _shrunk(g * self.of, other.of.shape))))

    def __matmul__(self, other: Value) -> Value:
        """``other`` is a matrix; all but the last axis of this one are kept."""
        wide = self.of.reshape(-1, self.of.shape[-1])
        return Value(self.of @ other.of, ((self, lambda g: g @ other.of.T), (other, lambda g: wide.T @ g.reshape(-1, g.shape[-1]))))

    def __getitem__(self, where) -> Value:
        def back(g):
            out = np.zeros_like(self.of)
            out[where] = g
            return out

        return Value(self.of[where], ((self, back),))


def _shrunk(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """A gradient summed over the axes along which its value was repeated."""
    g = g.sum(axis=tuple(range(g.ndim - len(shape))))
    return g.sum(axis=tuple(i for i, n in enumerate(shape) if n == 1 and g.shape[i] != 1), keepdims=True).reshape(shape)


def sigmoid(x: Value) -> Value:
    y = 1 / (1 + np.exp(-np.clip(x.of, -500, 500)))
    return Value(y, ((x, lambda g: g * y * (1 - y)),))


def tanh(x: Value) -> Value:
    y = np.tanh(x.of)
    return Value(y, ((x, lambda g: g * (1 - y * y)),))


def relu(x: Value) -> Value:
    return Value(np.maximum(x.of, 0), ((x, lambda g: g * (x.of > 0)),))


def softmax(x: Value, axis: int = -1) -> Value:
    e = np.exp(x.of - x.of.max(axis=axis, keepdims=True))
    y = e / e.sum(axis=axis, keepdims=True)
    return Value(y, ((x, lambda g: y * (g - (g * y).sum(axis=axis, keepdims=True))),))


def total(x: Value, axis: int) -> Value:
    """The sum along an axis, which goes."""
    return Value(x.of.sum(axis=axis), ((x, lambda g: np.broadcast_to(np.expand_dims(g, axis), x.of.shape)),))


def together(parts: list[Value], axis: int = -1) -> Value:
    ends = np.cumsum([p.of.shape[axis] for p in parts])
    piece = lambda g, i: np.take(g, np.arange(ends[i] - parts[i].of.shape[axis], ends[i]), axis)
    return Value(np.concatenate([p.of for p in parts], axis), tuple((p, lambda g, i=i: piece(g, i)) for i, p in enumerate(parts)))


def stacked(parts: list[Value], axis: int = 1) -> Value:
    return Value(np.stack([p.of for p in parts], axis), tuple((p, lambda g, i=i: np.take(g, i, axis)) for i, p in enumerate(parts)))


def shaped(x: Value, shape: tuple[int, ...]) -> Value:
    return Value(x.of.reshape(shape), ((x, lambda g: g.reshape(x.of.shape)),))


def padded(x: Value, before: int, after: int, axis: int) -> Value:
    """Zeros on both sides along an axis."""
    widths = [(before, after) if i == axis else (0, 0) for i in range(x.of.ndim)]
    n = x.of.shape[axis]
    return Value(np.pad(x.of, widths), ((x, lambda g: np.take(g, np.arange(before, before + n), axis)),))


def backward(result: Value, grad: np.ndarray) -> None:
    """Gradients of everything ``result`` was made of, from the result's own."""
    order: list[Value] = []
    seen: set[int] = set()
    todo = [(result, False)]
    while todo:
        v, ready = todo.pop()
        if ready:
            order.append(v)
        elif id(v) not in seen:
            seen.add(id(v))
            todo.append((v, True))
            todo += [(p, False) for p, _ in v.made_of]
    result.grad = grad
    for v in reversed(order):
        for p, how in v.made_of:
            g = how(v.grad)
            p.grad = g if p.grad is None else p.grad + g
