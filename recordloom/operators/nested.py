"""Nested JSON records into flat tables with parent-child links.

Method: vectorised structural indexing.  Payloads are laid end to end in one byte
buffer.  Bitmaps of quotes, brackets and delimiters are built with numpy; the
prefix sum of unescaped quotes tells what lies inside strings, the prefix sum of
brackets gives the nesting depth.  Sorting the structural characters by (depth,
position) puts every container next to its contents, so parents, keys and array
indexes are forward fills and running counts.  Spans are then cut out of the
buffer and emitted as linked rows.  The same order shows whether a text is JSON at
all: what stands in a container must alternate as the grammar says.  There is no
recursion, no object tree and no second parser, and no shuffle: every payload is
handled where it was read, however deep it nests.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of payload indexed at once (a longer single payload is indexed alone).
CHUNK_BYTES = 1 << 20
# Resources whose `name` holds human names.
NAMED = ("Patient", "Practitioner", "RelatedPerson")

_OPEN, _CLOSE = (123, 91), (125, 93)
_BLANK = (32, 9, 10, 13)
# What may stand outside strings and brackets, and after a backslash.
_SCALAR = re.compile(rb"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity")
_ESCAPE = re.compile(rb'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})')


def unwrap(payload: str | None) -> str | None:
    """The JSON text itself: without byte order mark, out of JSON strings; None if there is none."""
    text = payload
    while text is not None:
        text = text.lstrip("\ufeff \t\r\n")
        if not text.startswith('"'):
            return text.rstrip("\ufeff \t\r\n\x00") or None
        try:
            text = json.loads(text)  # one string: shorter each time, and never nested
        except ValueError:
            return None
    return None


class Index:
    """Structural index of several JSON texts.

    Arrays over *tokens* in text order: ``doc``, ``ch`` (``{`` ``[`` ``"``, and ``0`` for numbers and
    words), ``parent`` (token or -1), ``ordinal`` (place in the parent), ``key_tok`` and the
    span; ``nodes`` are the tokens that are values.  ``broken`` texts are no JSON.
    """

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.buf = b"\0".join(raw) + b"\0"
        b = np.frombuffer(self.buf, np.uint8)
        n = len(b)
        starts = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]]).astype(np.int64)
        where = np.arange(n, dtype=np.int32 if n < 2**31 else np.int64)
        # Quotes that are not escaped: an even run of backslashes stands before them.
        quotes = np.flatnonzero(b == 34)
        solid = np.maximum.accumulate(np.where(b == 92, -1, where))
        before = np.where(quotes > 0, quotes - 1 - solid[np.maximum(quotes - 1, 0)], 0)
        quotes = quotes[before % 2 == 0]
        # Prefix sum of quotes within each text; odd means inside a string.
        at_start = np.searchsorted(quotes, starts)
        doc_of = lambda p: np.searchsorted(starts, p, "right") - 1
        qdoc = doc_of(quotes)
        per_doc = np.bincount(qdoc, minlength=len(raw))
        broken = per_doc % 2 == 1
        parity = np.zeros(n, np.int8)
        parity[quotes] = 1
        parity = np.cumsum(parity, dtype=np.int64)
        parity -= np.repeat(np.concatenate([[0], np.cumsum(per_doc)[:-1]]), np.diff(np.append(starts, n)))
        inside = parity % 2 == 1
        structural = np.isin(b, (123, 125, 91, 93, 58, 44))
        struct = np.flatnonzero(structural & ~inside)
        opens_string = (np.arange(len(quotes)) - at_start[qdoc]) % 2 == 0
        first = quotes[opens_string & ~broken[qdoc]]
        last = quotes[~opens_string & ~broken[qdoc]]
        # Runs of other characters outside strings: numbers, true, false, null (or no JSON).
        other = ~inside & ~structural & ~np.isin(b, _BLANK) & (b != 34)
        other[starts[1:] - 1] = False
        other[n - 1] = False
        edge = np.diff(np.concatenate([[0], other.view(np.int8), [0]]))
        runs, run_ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # All tokens in text order: structural characters and starts of strings and scalars.
        pos = np.concatenate([struct, first, runs])
        ch = np.concatenate([b[struct], np.full(len(first), 34, np.uint8), np.full(len(runs), 48, np.uint8)])
        end = np.concatenate([np.zeros(len(struct), np.int64), last, run_ends])
        order = np.argsort(pos, kind="stable")
        pos, ch, end = pos[order], ch[order], end[order]
        doc = doc_of(pos)
        up, down = np.isin(ch, _OPEN), np.isin(ch, _CLOSE)
        step = up.astype(np.int64) - down
        total = np.cumsum(step)
        base = np.concatenate([[0], total])[np.searchsorted(pos, starts)]
        depth = total - base[doc]
        # A container belongs to the level it opens; everything else to the level it stands in.
        level = depth + down
        broken[np.unique(doc[depth < 0])] = True
        ends = np.searchsorted(pos, np.append(starts[1:], n)) - 1
        has = ends >= 0
        has[has] = doc[ends[has]] == np.flatnonzero(has)
        broken[np.flatnonzero(has)[depth[ends[has]] != 0]] = True
        broken[~has] = True
        # Sorted by (text, level, position) each container stands before its contents.  A nested
        # container appears twice: where it opens its own level, and as an element of the outer one.
        m = len(pos)
        t = np.arange(m)
        inner = np.flatnonzero(up)
        row_t = np.concatenate([t, inner])
        row_level = np.concatenate([level, level[inner] - 1])
        row_open = np.concatenate([up, np.zeros(len(inner), bool)])
        o = np.lexsort((row_t, row_level, doc[row_t]))
        rt, ropen, rlev, rdoc = row_t[o], row_open[o], row_level[o], doc[row_t][o]
        rch = np.where(ropen, 0, ch[rt])
        k = np.arange(len(rt))
        last_open = np.maximum.accumulate(np.where(ropen, k, -1)) if len(k) else k
        new_group = np.ones(len(rt), bool)
        new_group[1:] = (rlev[1:] != rlev[:-1]) | (rdoc[1:] != rdoc[:-1])
        group = np.maximum.accumulate(np.where(new_group, k, 0)) if len(k) else k
        holder = np.where((last_open >= group) & ~ropen, last_open, -1)
        commas = np.cumsum(rch == 44)
        place = commas - np.where(holder >= 0, commas[holder], 0)
        value = ~ropen & np.isin(rch, (123, 91, 34, 48))
        colon = rch == 58
        follows_colon = np.zeros(len(rt), bool)
        follows_colon[1:] = colon[:-1] & (holder[1:] == holder[:-1])
        before_colon = np.zeros(len(rt), bool)
        before_colon[:-1] = colon[1:] & (holder[1:] == holder[:-1])
        # The grammar: in an array values and commas take turns, in an object key, colon, value, comma;
        # a container closes with its own bracket after a value or at once.
        kind = np.where(holder >= 0, ch[rt[holder]], 0)
        nth = np.where(holder >= 0, k - holder - 1, 0)
        closing = np.isin(rch, _CLOSE)
        turn = np.where(kind == 91, nth % 2, nth % 4)
        good = np.where(
            kind == 91, np.where(closing, (rch == 93) & ((nth == 0) | (turn == 1)), np.where(turn == 0, value, rch == 44)),
            np.where(kind == 123, np.where(closing, (rch == 125) & ((nth == 0) | (turn == 3)), np.select([turn == 0, turn == 1, turn == 2], [rch == 34, colon, value], rch == 44)), value),
        )
        broken[np.unique(rdoc[~ropen & ~good])] = True
        for at, to in zip(runs[~broken[doc_of(runs)]].tolist(), run_ends[~broken[doc_of(runs)]].tolist()):
            if not _SCALAR.fullmatch(self.buf, at, to):
                broken[np.searchsorted(starts, at, "right") - 1] = True
        # In strings: no bare control characters, and known escapes only.
        broken[np.unique(doc_of(np.flatnonzero(inside & (b < 32))))] = True
        for d in np.unique(doc_of(np.flatnonzero(b == 92))):
            broken[d] |= b"\\" in _ESCAPE.sub(b"", raw[d])
        node = np.full(m, -1)
        parent, ordinal, key_tok = np.full(m, -1), np.zeros(m, np.int64), np.full(m, -1)
        e = np.flatnonzero(value & ~before_colon)
        node[rt[e]] = 1
        parent[rt[e]] = np.where(holder[e] >= 0, rt[holder[e]], -1)
        ordinal[rt[e]] = place[e]
        f = e[follows_colon[e] & (e >= 2)]
        key_tok[rt[f]] = rt[f - 2]
        self.pos, self.end, self.ch, self.doc, self.depth = pos, end, ch, doc, depth - up
        self.parent, self.ordinal, self.key_tok = parent, ordinal, key_tok
        self.nodes = np.flatnonzero(node == 1)
        self.broken = broken

    def text(self, token: int) -> str:
        """The string that starts at `token`, unescaped."""
        raw = self.buf[self.pos[token] + 1 : self.end[token]]
        if b"\\" in raw:
            return json.loads(b'"' + raw + b'"', strict=False)
        return raw.decode("utf-8", "surrogatepass")

    def members(self, key: str) -> np.ndarray:
        """Nodes that are the value of `key` in an object (the last one, if it is repeated)."""
        want = key.encode()
        v = self.nodes[self.key_tok[self.nodes] >= 0]
        kt = self.key_tok[v]
        same = (self.end[kt] - self.pos[kt] - 1) == len(want)
        v, kt = v[same], kt[same]
        arr = np.frombuffer(self.buf, np.uint8)
        hit = np.ones(len(v), bool)
        for i, c in enumerate(want):
            hit &= arr[self.pos[kt] + 1 + i] == c
        v = v[hit]
        _, last = np.unique(self.parent[v][::-1], return_index=True)
        return np.sort(v[::-1][last])

    def resources(self) -> tuple[dict[int, str], dict[int, str], dict[int, int]]:
        """Type and id of each object with a ``resourceType``, and the resource around it (-1: none)."""
        typed = self.members("resourceType")
        typed = typed[(self.ch[typed] == 34) & ~self.broken[self.doc[typed]]]
        kind = {int(self.parent[v]): self.text(v) for v in typed}
        ids = self.members("id")
        ids = ids[self.ch[ids] == 34]
        name = {int(self.parent[v]): self.text(v) for v in ids if int(self.parent[v]) in kind}
        is_resource = np.zeros(len(self.pos) + 1, bool)
        own = np.fromiter(kind, np.int64, len(kind))
        is_resource[own] = True
        up = np.append(self.parent, -1)
        around = up[own] if len(own) else own
        while True:
            climb = (around >= 0) & ~is_resource[around]
            if not climb.any():
                break
            around = np.where(climb, up[around], around)
        return kind, name, dict(zip(own.tolist(), around.tolist()))

    def elements(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Elements of array nodes, and lone nodes themselves: (holder's position in `nodes`, element, index)."""
        lone = np.flatnonzero(self.ch[nodes] != 91)
        lists = np.flatnonzero(self.ch[nodes] == 91)
        at = np.full(len(self.pos) + 1, -1)
        at[nodes[lists]] = lists
        inner = self.nodes[at[self.parent[self.nodes]] >= 0]
        inner = inner[self.parent[inner] >= 0]
        return (
            np.concatenate([lone, at[self.parent[inner]]]),
            np.concatenate([nodes[lone], inner]),
            np.concatenate([np.zeros(len(lone), np.int64), self.ordinal[inner]]),
        )


_RESOURCES = "bundle_id bigint, ordinal int, parent_id string, resource_id string, resource_type string"
_NAMES = "bundle_id bigint, parent_id string, resource_id string, name_ix bigint, given_ix bigint, given_name string"


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[int], list[str]]]:
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, p in zip(batch["bundle_id"], batch["payload"]):
            text = unwrap(p)
            if text is None or i is None:
                continue
            if held and held + len(text) > CHUNK_BYTES:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(int(i))
            texts.append(text)
            held += len(text)
    if texts:
        yield ids, texts


def _resource_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for ids, texts in _chunks(batches):
        ix = Index(texts)
        kind, name, around = ix.resources()
        rows, seen = [], {}
        for r in sorted(kind):
            d = int(ix.doc[r])
            seen[d] = seen.get(d, -1) + 1
            rows.append((ids[d], seen[d], name.get(around[r], ""), name.get(r), kind[r]))
        yield pd.DataFrame(rows, columns=["bundle_id", "ordinal", "parent_id", "resource_id", "resource_type"])


def _name_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for ids, texts in _chunks(batches):
        ix = Index(texts)
        kind, name, around = ix.resources()
        names = ix.members("name")
        names = names[[kind.get(int(p)) in NAMED for p in ix.parent[names]]] if len(names) else names
        owner, human, name_ix = ix.elements(names)
        humans = ix.ch[human] == 123
        owner, human, name_ix = owner[humans], human[humans], name_ix[humans]
        at = np.full(len(ix.pos) + 1, -1)
        at[human] = np.arange(len(human))
        given = ix.members("given")
        given = given[at[ix.parent[given]] >= 0]
        holder, value, given_ix = ix.elements(given)
        strings = ix.ch[value] == 34
        holder, value, given_ix = holder[strings], value[strings], given_ix[strings]
        h = at[ix.parent[given[holder]]]
        resource = ix.parent[names[owner[h]]]
        rows = []
        for r, v, ni, gi in zip(resource.tolist(), value.tolist(), name_ix[h].tolist(), given_ix.tolist()):
            if text := ix.text(v):
                rows.append((ids[int(ix.doc[r])], name.get(around[r], ""), name.get(r), ni, gi, text))
        yield pd.DataFrame(rows, columns=["bundle_id", "parent_id", "resource_id", "name_ix", "given_ix", "given_name"])


_NODES = "bundle_id bigint, node bigint, parent bigint, path string, ix bigint, kind string, value string"


def _node_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kinds = {123: "object", 91: "array", 34: "string", 48: "scalar"}
    for ids, texts in _chunks(batches):
        ix = Index(texts)
        v = ix.nodes[~ix.broken[ix.doc[ix.nodes]]]
        keys = [ix.text(t) if t >= 0 else None for t in ix.key_tok[v].tolist()]
        # Parents stand before their children in text order, so one pass names all paths.
        path: dict[int, str] = {-1: ""}
        rows = []
        first = np.searchsorted(ix.doc[v], np.arange(len(texts)))
        number = dict(zip(v.tolist(), range(len(v))))
        for t, key, up, c, d, o in zip(v.tolist(), keys, ix.parent[v].tolist(), ix.ch[v].tolist(), ix.doc[v].tolist(), ix.ordinal[v].tolist()):
            step = f"{path[up]}[]" if key is None and up >= 0 else f"{path[up]}.{key}" if path[up] else key or ""
            path[t] = step
            value = ix.text(t) if c == 34 else ix.buf[ix.pos[t] : ix.end[t]].decode() if c == 48 else None
            rows.append((ids[d], number[t] - int(first[d]), number[up] - int(first[d]) if up >= 0 else None, step, o if key is None and up >= 0 else None, kinds[c], None if value == "null" and c == 48 else value))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in _NODES.split(", ")])
        yield out.astype({"parent": "Int64", "ix": "Int64"})


def _payloads(df: DataFrame, key: str, payload: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("bundle_id"), F.col(payload).alias("payload"))


def resources(df: DataFrame, key: str = "bundle_id", payload: str = "payload") -> DataFrame:
    """One row per object with a ``resourceType``, at any depth, with its parent resource.

    ``ordinal`` numbers the resources of a payload in text order.  Null, empty,
    cut or otherwise unreadable payloads give no rows; payloads may be objects,
    arrays, values line by line, or JSON wrapped in a JSON string.  ``parent_id``
    is '' at the top; ``resource_id`` is null where a resource has none.
    """
    return _payloads(df, key, payload).mapInPandas(_resource_rows, _RESOURCES)


def given_names(df: DataFrame, key: str = "bundle_id", payload: str = "payload") -> DataFrame:
    """One row per non-empty given name of a person resource; indexes count from 0, nulls included."""
    return _payloads(df, key, payload).mapInPandas(_name_rows, _NAMES)


def nodes(df: DataFrame, key: str = "bundle_id", payload: str = "payload") -> DataFrame:
    """Every object, array and value of the payloads: ``node`` (number in text order), ``parent``, ``path``, ``ix`` in an array.

    A path has ``.key`` for each key and ``[]`` for each array, as ``entry[].resource.name[].given[]``.
    Strings and scalars have their ``value``; a null has none.  Payloads that are no JSON give no rows.
    """
    return _payloads(df, key, payload).mapInPandas(_node_rows, _NODES)


def table(tree: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """The flat table of one path of `nodes`: a row per object there, its `columns` (names of direct values), and the link to the object around it.

    (bundle_id, node, parent_object, ix, then the columns as text)  A repeated key keeps its last value.
    """
    objects = tree.where((F.col("path") == path) & (F.col("kind") == "object"))
    inner = tree.where(F.col("path").isin(*[f"{path}.{c}" if path else c for c in columns]) & F.col("kind").isin("string", "scalar"))
    name = F.substring_index("path", ".", -1)
    cells = inner.groupBy("bundle_id", F.col("parent").alias("node")).agg(*[F.max_by("value", F.when(name == c, F.col("node"))).alias(c) for c in columns])
    # The parent of an element is its array; the object around is the array's parent.
    arrays = tree.where(F.col("kind") == "array").select("bundle_id", F.col("node").alias("parent"), F.col("parent").alias("around"))
    linked = objects.join(arrays, ["bundle_id", "parent"], "left")
    return linked.join(cells, ["bundle_id", "node"], "left").select("bundle_id", "node", F.coalesce("around", "parent").alias("parent_object"), "ix", *columns)
