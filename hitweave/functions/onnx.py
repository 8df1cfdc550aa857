"""Small ONNX models without the onnx package: a linear score with a sigmoid."""

from __future__ import annotations

import struct

# Field numbers of the ONNX messages used here.
NODE_IN, NODE_OUT, NODE_OP = 1, 2, 4
GRAPH_NODE, GRAPH_NAME, GRAPH_TENSOR, GRAPH_IN, GRAPH_OUT = 1, 2, 5, 11, 12
TENSOR_DIM, TENSOR_TYPE, TENSOR_NAME, TENSOR_RAW = 1, 2, 8, 9
MODEL_VERSION, MODEL_GRAPH, MODEL_OPSET = 1, 7, 8
FLOAT = 1


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return _number(number << 3) + _number(value)
    data = value.encode() if isinstance(value, str) else value
    return _number(number << 3 | 2) + _number(len(data)) + data


def _node(op: str, inputs: list[str], output: str) -> bytes:
    return b"".join(_field(NODE_IN, i) for i in inputs) + _field(NODE_OUT, output) + _field(NODE_OP, op)


def _tensor(name: str, dims: list[int], values: list[float]) -> bytes:
    raw = struct.pack(f"<{len(values)}f", *values)
    return b"".join(_field(TENSOR_DIM, d) for d in dims) + _field(TENSOR_TYPE, FLOAT) + _field(TENSOR_NAME, name) + _field(TENSOR_RAW, raw)


def _value(name: str, width: int) -> bytes:
    shape = _field(1, _field(2, "rows")) + _field(1, _field(1, width))
    return _field(1, name) + _field(2, _field(1, _field(1, FLOAT) + _field(2, shape)))


def linear_model(weights: list[float], bias: float) -> bytes:
    """The model ``sigmoid(x . weights + bias)`` for rows x of floats, as the content of an ONNX file."""
    n = len(weights)
    nodes = [_node("MatMul", ["x", "weights"], "product"), _node("Add", ["product", "bias"], "sum"), _node("Sigmoid", ["sum"], "score")]
    graph = b"".join(_field(GRAPH_NODE, x) for x in nodes) + _field(GRAPH_NAME, "linear")
    graph += _field(GRAPH_TENSOR, _tensor("weights", [n, 1], weights)) + _field(GRAPH_TENSOR, _tensor("bias", [1], [bias]))
    graph += _field(GRAPH_IN, _value("x", n)) + _field(GRAPH_OUT, _value("score", 1))
    return _field(MODEL_VERSION, 8) + _field(MODEL_GRAPH, graph) + _field(MODEL_OPSET, _field(1, "") + _field(2, 13))
