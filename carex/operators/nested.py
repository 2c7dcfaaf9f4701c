"""Deeply nested semi-structured records as linked flat rows (problem 5).

Vectorised structural indexing: the documents of a batch lie in one buffer of bytes. Bitmaps of quotes, brackets and
delimiters are made over all of it, the text within strings is masked by a prefix sum over unescaped quotes, the
depth of each bracket is a prefix sum of openings and closings, and the spans between structural characters give
keys and values. Paths are then joined depth by depth, so that the number of vector operations follows the depth
and not the number of elements.

Null and edge cases: null and unreadable documents have no rows, nor have documents that are a lone scalar. A
document wrapped in a JSON string counts as the document. Null elements have no row but keep their position. A list
directly within a list is no row itself; its elements are, below its place. Empty lists have no rows. For names
that always hold lists a lone value is element [0]. Of a repeated key in one object nothing is read (the document
counts as unreadable), and text after the end of a document makes it unreadable. Repeated rows repeat their rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

ALWAYS_LISTS = ("coding", "telecom", "identifier", "line")

_OPEN_OBJECT, _CLOSE_OBJECT, _OPEN_LIST, _CLOSE_LIST, _COMMA, _COLON, _QUOTE, _BACKSLASH = b"{}[],:\"\\"
_STRUCTURAL = np.zeros(256, dtype=bool)
_STRUCTURAL[list(b"{}[],:")] = True
_DEPTH = np.zeros(256, dtype=np.int8)
_DEPTH[list(b"{[")], _DEPTH[list(b"}]")] = 1, -1
_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(b" \t\r\n")] = True


def _unescaped_quotes(buffer: np.ndarray) -> np.ndarray:
    """Bitmap of the quotes that open or close a string: those behind an even run of backslashes."""
    quotes = buffer == _QUOTE
    slashes = buffer == _BACKSLASH
    if slashes.any():
        at = np.flatnonzero(slashes)
        first = np.concatenate(([True], np.diff(at) > 1))
        starts = at[first]
        lengths = np.diff(np.append(np.flatnonzero(first), len(at)))
        behind = starts + lengths
        odd = behind[(lengths & 1) == 1]
        odd = odd[odd < len(buffer)]
        quotes[odd] = False
    return quotes


def _trimmed(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without the blanks at their ends; as many steps as the longest run of blanks."""
    start, end = start.copy(), end.copy()
    while (blank := (start < end) & _BLANK[buffer[start]]).any():
        start += blank
    while (blank := (start < end) & _BLANK[buffer[end - 1]]).any():
        end -= blank
    return start, end


def _keys(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The place of each key among the distinct ones, and those."""
    known: dict[bytes, int] = {}
    codes = np.fromiter(
        (known.setdefault(raw[a:b], len(known)) for a, b in zip(start.tolist(), end.tolist())), np.int64, len(start)
    )
    return codes, [json.loads(k) for k in known]


def _closed(buffer: np.ndarray, doc: np.ndarray, tokens: np.ndarray, depth: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each document closes what it opens, once, and has nothing but blanks behind that."""
    once = np.bincount(doc[depth <= 0], minlength=len(tokens)) == 1
    last, level = np.full(len(tokens), -1, dtype=np.int64), np.zeros(len(tokens), dtype=np.int64)
    last[doc], level[doc] = at, depth
    _, stop = _trimmed(buffer, start, end)
    return (once & (level == 0) & (stop == last + 1)) | (tokens == 0)


def element_rows(documents: list[str], always_lists: tuple[str, ...] = ALWAYS_LISTS) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(place of the document, node_path, parent_path) of each element of each list of readable documents."""
    none = np.zeros(0, dtype=np.int64), pa.array([], pa.string()), pa.array([], pa.string())
    if not documents:
        return none
    encoded = [d.encode("utf-8", "replace") for d in documents]
    raw = b"\n".join(encoded) + b"\n"
    buffer = np.frombuffer(raw, dtype=np.uint8)
    lengths = np.array([len(d) + 1 for d in encoded], dtype=np.int64)
    ends = np.cumsum(lengths)
    quotes = _unescaped_quotes(buffer)
    total = np.concatenate(([0], np.cumsum(quotes, dtype=np.int32)))
    inside = ((total[1:] - np.repeat(total[ends - lengths], lengths)) & 1).astype(bool)
    at = np.flatnonzero(_STRUCTURAL[buffer] & ~inside)
    kind = buffer[at]
    step = _DEPTH[kind].astype(np.int64)
    doc = np.searchsorted(ends, at, side="right")
    tokens = np.bincount(doc, minlength=len(documents))
    sums = np.concatenate(([0], np.cumsum(step)))
    depth = sums[1:] - np.repeat(sums[np.cumsum(tokens) - tokens], tokens)  # behind each character
    even = (total[ends] - total[ends - lengths]) % 2 == 0
    whole = even & _closed(buffer, doc, tokens, depth, at, ends - lengths, ends)
    if not whole.all():
        kept = np.flatnonzero(whole)
        place, node, parent = element_rows([documents[k] for k in kept], always_lists)
        return kept[place], node, parent
    own = depth - (step > 0)  # of the container that holds it
    opens = np.flatnonzero(step > 0)
    if not len(opens):
        return none
    start_of = np.full(len(at), -1, dtype=np.int64)  # the opening bracket of the container that holds a delimiter
    deepest = int(depth.max())
    for d in range(1, deepest + 1):
        here = opens[depth[opens] == d]
        members = np.flatnonzero((own == d) & (step >= 0))
        start_of[members] = here[np.searchsorted(here, members, side="right") - 1] if len(here) else -1

    # Slots: what follows the opening of a list, a comma within a list, or a colon.
    container = np.where(step > 0, np.arange(len(at)), start_of)
    in_list = (container >= 0) & (kind[np.maximum(container, 0)] == _OPEN_LIST)
    slot = np.flatnonzero((kind == _OPEN_LIST) | ((kind == _COMMA) & in_list) | (kind == _COLON))
    holder = container[slot]
    is_key = kind[slot] == _COLON
    value_start, value_end = _trimmed(buffer, at[slot] + 1, at[np.minimum(slot + 1, len(at) - 1)])
    next_kind = kind[np.minimum(slot + 1, len(at) - 1)]
    nested = _DEPTH[next_kind] > 0
    child = np.where(nested, slot + 1, -1)
    empty = ~nested & (value_end == value_start)
    first = buffer[np.minimum(value_start, len(buffer) - 1)]
    null = ~nested & (first == ord("n"))

    # Positions within lists: how many commas of the same list lie before.
    position = np.zeros(len(slot), dtype=np.int64)
    lists = np.flatnonzero(~is_key)
    order = lists[np.lexsort((slot[lists], holder[lists]))]
    if len(order):
        begins = np.concatenate(([True], np.diff(holder[order]) != 0))
        run = np.arange(len(order))
        position[order] = run - np.maximum.accumulate(np.where(begins, run, 0))

    key_at = np.flatnonzero(is_key)
    key_start, key_end = _trimmed(buffer, at[slot[key_at] - 1] + 1, at[slot[key_at]])
    codes, distinct = _keys(raw, key_start, key_end)
    code = np.full(len(slot), -1, dtype=np.int64)
    code[key_at] = codes
    table = np.array([*distinct, ""], dtype=object)
    lone = np.array([*(k in always_lists for k in distinct), False])[code] & ~((next_kind == _OPEN_LIST) & nested)

    doc_of = doc[slot]
    slot_depth = own[slot] + (step[slot] > 0)
    paths = np.full(len(at), "", dtype=object)
    elements = np.full(len(at), "", dtype=object)
    out_doc, out_path, out_parent = [], [], []
    for d in range(1, deepest + 1):
        here = np.flatnonzero(slot_depth == d)
        if not len(here):
            continue
        base = pa.array(paths[holder[here]], pa.string())
        keyed = is_key[here]
        dot = pa.array(np.where(keyed & (paths[holder[here]] != ""), ".", np.where(keyed, "", "[")).tolist(), pa.string())
        tail = pa.array(np.where(keyed, np.where(lone[here], "[0]", ""), "]").tolist(), pa.string())
        middle = pa.array(np.where(keyed, table[code[here]], position[here].astype(str).astype(object)).tolist(), pa.string())
        full = pc.binary_join_element_wise(base, dot, middle, tail, "").to_numpy(zero_copy_only=False)
        up = elements[holder[here]]
        list_child = nested[here] & (next_kind[here] == _OPEN_LIST)
        element = (~keyed | lone[here]) & ~list_child
        rows = element & ~null[here] & ~empty[here]
        out_doc.append(doc_of[here][rows])
        out_path.append(full[rows])
        out_parent.append(up[rows])
        deeper = nested[here]
        paths[child[here][deeper]] = full[deeper]
        elements[child[here][deeper]] = np.where(element, full, up)[deeper]
    if not out_doc:
        return none
    return (
        np.concatenate(out_doc),
        pa.array(np.concatenate(out_path), pa.string()),
        pa.array(np.concatenate(out_parent), pa.string()),
    )


def readable_documents(resources: DataFrame) -> DataFrame:
    """(id, document): documents that hold an object or a list, unwrapped from a JSON string where wrapped."""
    value = resources.select("id", "resource", F.expr("try_parse_json(resource)").alias("v"))
    wrapped = F.expr("schema_of_variant(v) = 'STRING'")
    text = value.select("id", F.when(wrapped, F.expr("try_variant_get(v, '$', 'string')")).otherwise(F.col("resource")).alias("document"))
    return text.where("try_parse_json(document) is not null")


def list_elements(resources: DataFrame, always_lists: tuple[str, ...] = ALWAYS_LISTS, batch_bytes: int = 1_500_000) -> DataFrame:
    """(id, node_path, parent_path): one row for each element of each list at any depth.

    `batch_bytes` bounds the buffer that is indexed at once; a longer document is indexed alone.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "node_path", "parent_path"]
        for b in batches:
            ids, docs = b.column("id"), b.column("document").to_pylist()
            start = 0
            while start < len(docs):
                end, held = start, 0
                while end < len(docs) and (end == start or held + len(docs[end]) <= batch_bytes):
                    held += len(docs[end])
                    end += 1
                doc, node, parent = element_rows(docs[start:end], always_lists)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc + start)), node, parent], names)
                start = end

    return readable_documents(resources).mapInArrow(index, "id bigint, node_path string, parent_path string")
