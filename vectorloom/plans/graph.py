"""Computation graphs: built once, compiled to an order of evaluation, run as numpy batches or as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec

#: Number of inputs of each operation.
ARITY = {"create": 0, "relu": 1, "softmax": 1, "add": 2, "sub": 2, "matmul": 2, "cross_entropy": 2}


@dataclass(eq=False)
class Node:
    op: str
    rows: int
    cols: int
    inputs: tuple[Node, ...] = ()
    requires_grad: bool = False
    parameter: bool = False
    value: np.ndarray | None = None
    grad: np.ndarray | None = None


@dataclass
class Graph:
    """One sample is a column vector, as in x (784 x 1). The last node given a role holds it."""

    nodes: list[Node] = field(default_factory=list)
    input: Node | None = None
    output: Node | None = None
    target: Node | None = None
    cost: Node | None = None
    forward: list[Node] = field(default_factory=list)
    backward: list[Node] = field(default_factory=list)

    def variable(self, rows: int, cols: int, role: str = "", parameter: bool = False, requires_grad: bool = False) -> Node:
        node = Node("create", rows, cols, (), requires_grad or parameter, parameter, np.zeros((rows, cols)), np.zeros((rows, cols)))
        return self._add(node, role)

    def _add(self, node: Node, role: str = "") -> Node:
        self.nodes.append(node)
        if role:
            if role not in ("input", "output", "target", "cost"):
                raise ValueError(f"no role {role}")
            setattr(self, role, node)
        return node

    def _op(self, op: str, rows: int, cols: int, inputs: tuple[Node, ...], role: str) -> Node:
        return self._add(Node(op, rows, cols, inputs, any(i.requires_grad for i in inputs)), role)

    def relu(self, a: Node, role: str = "") -> Node:
        return self._op("relu", a.rows, a.cols, (a,), role)

    def softmax(self, a: Node, role: str = "") -> Node:
        return self._op("softmax", a.rows, a.cols, (a,), role)

    def _alike(self, op: str, a: Node, b: Node, role: str) -> Node:
        if (a.rows, a.cols) != (b.rows, b.cols):
            raise ValueError(f"{op}: shapes differ")
        return self._op(op, a.rows, a.cols, (a, b), role)

    def add(self, a: Node, b: Node, role: str = "") -> Node:
        return self._alike("add", a, b, role)

    def sub(self, a: Node, b: Node, role: str = "") -> Node:
        return self._alike("sub", a, b, role)

    def cross_entropy(self, p: Node, q: Node, role: str = "") -> Node:
        return self._alike("cross_entropy", p, q, role)

    def matmul(self, a: Node, b: Node, role: str = "") -> Node:
        if a.cols != b.rows:
            raise ValueError("matmul: shapes do not fit")
        return self._op("matmul", a.rows, b.cols, (a, b), role)

    def compile(self) -> Graph:
        """Orders of evaluation that end at the output and at the cost; nodes neither reaches are left out."""
        self.forward = topological(self.output) if self.output else []
        self.backward = topological(self.cost) if self.cost else []
        return self

    def clear_gradients(self) -> None:
        for p in self.parameters():
            p.grad = np.zeros((p.rows, p.cols))

    def accumulate(self, feed: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Evaluate the cost for a batch and add its gradients to those the parameters have; the values of all nodes."""
        val = run(self.backward, feed)
        grad = gradients(self.backward, val)
        for p in self.parameters():
            if id(p) in grad:
                p.grad = p.grad + grad[id(p)]
        return val

    def parameters(self) -> list[Node]:
        return [n for n in (self.backward or self.forward) if n.parameter]


def topological(root: Node) -> list[Node]:
    """Inputs before the nodes that use them, last inputs first, each once; without recursion.

    Parameters are stored and trained in this order.
    """
    out, done, stack = [], set(), [(root, False)]
    while stack:
        node, ready = stack.pop()
        if id(node) in done:
            continue
        if ready:
            done.add(id(node))
            out.append(node)
        else:
            stack.append((node, True))
            stack.extend((i, False) for i in node.inputs)
    return out


def run(order: list[Node], feed: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Values of all nodes for a batch: arrays (samples, rows, cols); parameters are (rows, cols)."""
    val: dict[int, np.ndarray] = {}
    for n in order:
        a = [val[id(i)] for i in n.inputs]
        if n.op == "create":
            v = feed.get(id(n), n.value)
        elif n.op == "relu":
            v = np.where(a[0] > 0, a[0], 0.0)
        elif n.op == "softmax":
            e = np.exp(a[0] - a[0].max(axis=(-2, -1), keepdims=True))
            v = e / e.sum(axis=(-2, -1), keepdims=True)
        elif n.op == "add":
            v = a[0] + a[1]
        elif n.op == "sub":
            v = a[0] - a[1]
        elif n.op == "matmul":
            v = a[0] @ a[1]
        else:
            v = np.where(a[0] == 0, 0.0, -a[0] * np.log(a[1] + vec.EPSILON))
        val[id(n)] = v
    return val


def gradients(order: list[Node], val: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Gradients of the last node's sum for every node that requires one, added over the samples for parameters.

    A softmax passes its gradient through and a cross-entropy gives q - p, so the two are meant to stand together.
    """
    grad: dict[int, np.ndarray] = {id(order[-1]): np.ones_like(val[id(order[-1])])}

    def give(node: Node, g: np.ndarray) -> None:
        if node.requires_grad:
            if node.parameter and g.ndim == 3:
                g = g.sum(axis=0)
            grad[id(node)] = grad[id(node)] + g if id(node) in grad else g

    for n in reversed(order):
        g = grad.get(id(n))
        if g is None or not n.inputs or not n.requires_grad:
            continue
        a = [val[id(i)] for i in n.inputs]
        if n.op == "relu":
            give(n.inputs[0], np.where(a[0] > 0, g, 0.0))
        elif n.op == "softmax":
            give(n.inputs[0], g)
        elif n.op in ("add", "sub"):
            give(n.inputs[0], g)
            give(n.inputs[1], g if n.op == "add" else -g)
        elif n.op == "matmul":
            # A stored matrix's gradient is summed over the samples at once, not made for each of them first.
            both = n.inputs[0].parameter and g.ndim == a[1].ndim == 3
            give(n.inputs[0], np.tensordot(g, a[1], axes=([0, 2], [0, 2])) if both else g @ np.swapaxes(a[1], -1, -2))
            if n.inputs[1].requires_grad:
                give(n.inputs[1], np.swapaxes(a[0], -1, -2) @ g)
        else:
            give(n.inputs[0], -np.log(a[1] + vec.EPSILON) * g)
            give(n.inputs[1], (a[1] - a[0]) * g)
    return grad


def _times(x: Column):
    return lambda w: F.aggregate(F.zip_with(w, x, lambda p, q: p * q), F.lit(0.0), lambda t, y: t + y)


def with_output(order: list[Node], df: DataFrame, feed: dict[int, Column], out: str) -> DataFrame:
    """df with the value of the last node over column vectors, without Python.

    Every inner node becomes a column of its own step by step, so a node that is used twice is computed once and the
    plan grows with the number of nodes.
    """
    kept, cols = df.columns, dict(feed)
    for k, n in enumerate(order):
        if n.op == "create":
            cols.setdefault(id(n), vec.vector(n.value.ravel().tolist()))
            continue
        a = [cols[id(i)] for i in n.inputs]
        if n.op == "matmul":
            if n.inputs[0].op != "create" or n.cols != 1:
                raise ValueError("only a stored matrix times a column vector becomes a column")
            rows = F.array(*[vec.vector(row) for row in n.inputs[0].value.tolist()])
            value = F.transform(rows, _times(a[1]))
        else:
            value = {"relu": vec.relu, "softmax": vec.softmax, "add": vec.add, "sub": vec.sub, "cross_entropy": vec.cross_entropy}[n.op](*a)
        df = df.withColumn(f"_node{k}", value)
        cols[id(n)] = F.col(f"_node{k}")
    return df.select(*kept, cols[id(order[-1])].alias(out))


def xavier(node: Node, fan_in: int, fan_out: int, fill) -> None:
    reach = (6.0 / (fan_in + fan_out)) ** 0.5
    node.value = fill(node.rows, node.cols, -reach, reach)


def residual_classifier(inputs: int = 784, hidden: int = 16, classes: int = 10, generator=None) -> Graph:
    """inputs -> relu(hidden) -> residual relu(hidden) -> softmax(classes), with cross-entropy; biases start at zero."""
    from ..functions.rng import PCG32

    g, draw = Graph(), (generator or PCG32()).fill
    x = g.variable(inputs, 1, "input")
    w0, w1, w2 = g.variable(hidden, inputs, parameter=True), g.variable(hidden, hidden, parameter=True), g.variable(classes, hidden, parameter=True)
    b0, b1, b2 = g.variable(hidden, 1, parameter=True), g.variable(hidden, 1, parameter=True), g.variable(classes, 1, parameter=True)
    for w in (w0, w1, w2):
        xavier(w, w.cols, w.rows, draw)
    a0 = g.relu(g.add(g.matmul(w0, x), b0))
    a1 = g.add(a0, g.relu(g.add(g.matmul(w1, a0), b1)))
    out = g.softmax(g.add(g.matmul(w2, a1), b2), "output")
    y = g.variable(classes, 1, "target")
    g.cross_entropy(y, out, "cost")
    return g.compile()
