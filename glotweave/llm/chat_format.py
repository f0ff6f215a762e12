"""Chat formatting with tool-call linking.

Method.  Turns are parsed into messages, tool calls and tool results.  Calls and results are hash-joined on conversation and
call id.  Within a conversation the messages are ordered topologically (a result after its call, a call after the calls
whose results its arguments refer to, otherwise by turn), arguments are validated against the tool's schema, and everything
is written as canonical JSON: keys sorted by code point, no insignificant spaces, characters unescaped where JSON and UTF-8
allow (half a surrogate pair stays an escape).

A call stands in an assistant turn whose text is a JSON object with ``tool_calls``: a list of objects with ``id``, ``name``
and ``arguments`` (an object, or its JSON text).  A result is a ``tool`` turn whose text is a JSON object with
``tool_call_id`` and ``content``.  Arguments refer to a result as ``{"$result": "<call id>"}``.  Any other text is a plain
message.

Scale: turns are grouped by (conversation, turn div ``part_turns``); longer conversations come out as several parts, in
order.  Parts bound only the rows that are assembled: results, repeated ids and references are joined on (conversation,
call id) before, over whole conversations.  A result travels to the part of its call, a call that refers to later ones to
the part of the latest it waits for.  Only calls and results are joined, messages go straight to their part.  Turns that can
hold calls or results are told apart in the JVM; they alone are parsed, once, and kept in the shared scratch folder.  The
order of calls is found per conversation from the references alone (ids and turns), and only where a call refers to a later
one: references to earlier calls neither move a call nor close a circle.

Defined cases: rows with a null conv_id or turn cannot be placed and are left out.  Rows alike in conversation, turn, role
and text count once; other rows of one turn are ordered by role, then text.  A null role is written as "unknown", a null
text as null.  A part of which only dropped results are left has no messages.  A call that repeats an id has no result of its
own.  Calls in a circle, and those that wait for them, come last in the part of their turn.  Results without a call, and second results of one call (the earliest stays), are dropped and counted in
``n_orphans``.  A call without a result, with invalid arguments, of an unknown tool, that repeats an id, or that refers in a
circle or to nothing stays and carries ``errors``.  Whole numbers of more
than ``MAX_DIGITS`` characters are written as they came.  A text that is not JSON by the standard (``NaN``, numbers beyond double
precision's range) or is nested deeper than ``MAX_DEPTH`` is a plain message; arguments that are such text stay text.  Of a key that
an object repeats, the last value counts.  Extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import heapq
import json
import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotweave.llm.storage import materialise

PART_TURNS = 512
#: Levels of JSON; deeper text is a plain message.
MAX_DEPTH = 256
#: Whole numbers of more characters are kept as they are written.
MAX_DIGITS = 4000
_HALF_PAIR = re.compile("[\ud800-\udfff]")


@dataclass(frozen=True)
class Literal:
    """A long whole number, as it is written."""

    text: str


_TYPES = {
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: isinstance(v, (int, Literal)) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, (int, float, Literal)) and not isinstance(v, bool),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
    "null": lambda v: v is None,
}


def canonical(value) -> str:
    literals: dict[str, str] = {}

    def stand_in(number: Literal) -> str:
        name = uuid.uuid4().hex
        literals[name] = number.text
        return name

    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=stand_in)
    for name, number in literals.items():
        text = text.replace(f'"{name}"', number)
    return _HALF_PAIR.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """How ``value`` breaks a JSON schema (type, enum, required, properties, additionalProperties, items)."""
    if isinstance(value, dict) and set(value) == {"$result"}:
        return []  # stands for a result that is not known yet
    kind = schema.get("type")
    if kind is not None and not any(_TYPES[k](value) for k in ([kind] if isinstance(kind, str) else kind)):
        return [f"{at}: not {kind}"]
    found = [f"{at}: not one of {canonical(schema['enum'])}"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                found += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{k}: not allowed")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += violations(x, schema["items"], f"{at}[{i}]")
    return found


def references(value) -> set[str]:
    if isinstance(value, dict):
        if set(value) == {"$result"} and isinstance(value["$result"], str):
            return {value["$result"]}
        return set().union(*map(references, value.values())) if value else set()
    return set().union(*map(references, value)) if isinstance(value, list) and value else set()


def _whole(text: str) -> int | Literal:
    return int(text) if len(text) <= MAX_DIGITS else Literal(text)


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(f"{text} is beyond the range of numbers")
    return value


def _no_constant(text: str):
    raise ValueError(f"{text} is not JSON")


def _loads(text: str):
    return json.loads(text, parse_int=_whole, parse_float=_finite, parse_constant=_no_constant)


def _depth(value) -> int:
    level, here = 0, [value]
    while here:
        level += 1
        here = [x for v in here for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()) if isinstance(x, (dict, list))]
    return level


def _object(text: str | None) -> dict | None:
    if not text or text.lstrip()[:1] != "{":
        return None
    try:
        found = _loads(text)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) and _depth(found) <= MAX_DEPTH else None


def _arguments(args):
    if isinstance(args, str):
        found = _object(args)
        return args if found is None else found
    return {} if args is None else args


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind p (plain message: body is its text), m (message: body is its content), c (call: body is its name and arguments,
    refs the ids it refers to) or r (result: body is its content).  Bodies of m, c and r, and all ids, are canonical JSON."""
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        for conv, turn, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")]):
            body = _object(text) if role in ("assistant", "tool") else None
            rows = []
            if role == "tool" and body and isinstance(body.get("tool_call_id"), str) and "content" in body:
                rows.append(("r", 0, canonical(body["tool_call_id"]), canonical(body["content"]), None))
            elif role == "assistant" and body and isinstance(body.get("tool_calls"), list) and body["tool_calls"] and all(
                isinstance(c, dict) and isinstance(c.get("id"), str) and isinstance(c.get("name"), str) for c in body["tool_calls"]
            ):
                if body.get("content") is not None:
                    rows.append(("m", 0, None, canonical(body["content"]), None))
                rows += [
                    ("c", k + 1, canonical(c["id"]), canonical([c["name"], c.get("arguments")]), sorted(map(canonical, references(_arguments(c.get("arguments"))))))
                    for k, c in enumerate(body["tool_calls"])
                ]
            else:
                rows.append(("p", 0, None, text, None))
            for row in rows:
                for column, value in zip(out, (conv, turn, "unknown" if role is None else role, *row)):
                    column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["conv_id", "turn", "role", "kind", "seq", "call_id", "body", "refs"])


def _waits(edges: list[tuple[int, int, int | None, int | None]]) -> Iterator[tuple[int, int, bool, bool]]:
    """(call, latest turn it waits for, in or behind a circle, refers to nothing) of one conversation's calls with references.

    ``edges`` are (call, its turn, call referred to, its turn), the latter null if there is none.
    """
    turn, latest, needs, nothing = {}, {}, {}, set()
    for call, at, other, other_at in edges:
        turn[call] = at
        needs.setdefault(call, set())
        if other is None or other == call:
            nothing.add(call)
        else:
            latest.setdefault(other, other_at)
            needs[call].add(other)
    latest.update(turn)
    left = {call: len(others & needs.keys()) for call, others in needs.items()}
    unblocks: dict[int, list[int]] = {}
    for call, others in needs.items():
        for other in others:
            unblocks.setdefault(other, []).append(call)
    ready = [call for call, n in left.items() if not n]
    done = set()
    while ready:
        call = ready.pop()
        done.add(call)
        latest[call] = max([turn[call], *(latest[o] for o in needs[call])])
        for other in unblocks.get(call, ()):
            left[other] -= 1
            if not left[other]:
                ready.append(other)
    for call in needs:
        yield call, latest[call] if call in done else turn[call], call not in done, call in nothing


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_waits`` over rows sorted by conversation."""

    def told(conv, edges):
        columns = list(zip(*_waits(edges)))
        return pa.RecordBatch.from_arrays(
            [pa.array([conv] * len(columns[0]), pa.int64()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2]), pa.array(columns[3])],
            ["conv_id", "node", "latest", "circular", "nothing"],
        )

    now, edges = None, []
    for batch in batches:
        for conv, *edge in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "node", "turn", "other", "other_turn")]):
            if edges and conv != now:
                yield told(now, edges)
                edges = []
            now = conv
            edges.append(tuple(edge))
    if edges:
        yield told(now, edges)


def assemble(events: list[dict], schemas: dict[str, dict]) -> tuple[list[dict], int, int]:
    """Ordered messages of one part, number of calls, number of calls with errors.

    ``events`` are messages and calls in order of turn; a call has its result, if there is one, and what is known of it from
    the whole conversation: whether it is the first of its id, stands in or behind a circle, or refers to nothing.
    """
    nodes, first_of = [], {}
    for e in events:
        if e["kind"] != "c":
            nodes.append({"role": e["role"], "content": e["body"] if e["kind"] == "p" else _loads(e["body"])})
            continue
        name, args = _loads(e["body"])
        errors = []
        args = _arguments(args)
        if name in schemas:
            errors += violations(args, schemas[name])
        else:
            errors.append(f"unknown tool {name}")
        result = None
        if not e["first"] or e["call_id"] in first_of:
            errors.append("repeated id")
        else:
            first_of[e["call_id"]] = len(nodes)
            result = e["result"]
            if result is None:
                errors.append("no result")
        if e["nothing"]:
            errors.append("reference to nothing")
        call = {"role": e["role"], "tool_call": {"id": _loads(e["call_id"]), "name": name, "arguments": args}}
        needs = sorted(map(canonical, references(args)))
        nodes.append({"call": call, "result": result, "errors": errors, "needs": needs, "circular": e["circular"]})
    waits: list[set[int]] = []
    for i, node in enumerate(nodes):
        waits.append({first_of[r] for r in node.get("needs", ()) if r in first_of} - {i})
    unblocks: list[list[int]] = [[] for _ in nodes]
    for i, needs in enumerate(waits):
        for k in needs:
            unblocks[k].append(i)
    ready = [i for i, needs in enumerate(waits) if not needs and not nodes[i].get("circular")]
    heapq.heapify(ready)
    order = []
    while ready:
        i = heapq.heappop(ready)
        order.append(i)
        for k in unblocks[i]:
            waits[k].discard(i)
            if not waits[k]:
                heapq.heappush(ready, k)
    for i in sorted(set(range(len(nodes))) - set(order)):
        nodes[i]["errors"].append("circular reference")
        order.append(i)
    messages, n_calls, n_bad = [], 0, 0
    for i in order:
        node = nodes[i]
        if "call" not in node:
            messages.append(node)
            continue
        n_calls += 1
        if node["errors"]:
            n_bad += 1
            node["call"]["errors"] = node["errors"]
        messages.append(node["call"])
        if node["result"] is not None:
            messages.append({"role": "tool", "tool_call_id": node["call"]["tool_call"]["id"], "content": _loads(node["result"])})
    return messages, n_calls, n_bad


def _write(schemas: dict[str, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                out: list[list] = [[] for _ in range(7)]
                for conv, number, events in zip(*[part.column(c).to_pylist() for c in ("conv_id", "part", "events")]):
                    messages, n_calls, n_bad = assemble([e for e in events if e["kind"] != "o"], schemas)
                    n_orphans = sum(int(e["body"]) for e in events if e["kind"] == "o")
                    line = canonical({"conv_id": conv, "part": number, "messages": messages})
                    for column, value in zip(out, (conv, number, len(messages), n_calls, n_bad, n_orphans, line)):
                        column.append(value)
                kinds = [pa.int64()] * 6 + [pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, kinds)], ["conv_id", "part", "n_messages", "n_calls", "n_bad_calls", "n_orphans", "chat"]
                )

    return run


def format_chats(turns: DataFrame, schemas: dict[str, dict] | None = None, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, part, n_messages, n_calls, n_bad_calls, n_orphans, chat (canonical JSON): one row per conversation part."""
    clean = (
        turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
        .filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
        .distinct()
    )
    may_link = F.coalesce(F.col("role").isin("assistant", "tool") & F.col("text").rlike("^\\s*\\{"), F.lit(False))
    parsed = materialise(
        clean.filter(may_link).mapInArrow(
            _parse, "conv_id long, turn long, role string, kind string, seq int, call_id string, body string, refs array<string>"
        ),
        "chat-events",
    )
    tools = parsed.filter("kind in ('c', 'r')").withColumn("node", F.xxhash64("turn", "seq", "call_id", "body"))
    messages = (
        clean.filter(~may_link)
        .select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.lit("p").alias("kind"), F.lit(0).alias("seq"), F.col("text").alias("body"))
        .union(parsed.filter("kind in ('p', 'm')").select("conv_id", "turn", "role", "kind", "seq", "body"))
    )
    results = (
        tools.filter("kind = 'r'").groupBy("conv_id", "call_id")
        .agg(F.min(F.struct("turn", "body")).alias("found"), F.count("*").alias("n"))
        .select("conv_id", "call_id", F.col("found.turn").alias("result_turn"), F.col("found.body").alias("result"), "n")
    )
    calls = tools.filter("kind = 'c'")
    known = (
        calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "seq", "body", "node")).alias("call"))
        .select("conv_id", "call_id", F.col("call.node").alias("first_node"), F.col("call.turn").alias("first_turn"), F.col("call.seq").alias("first_seq"))
    )
    edges = materialise(
        calls.select("conv_id", "node", "turn", "seq", F.explode("refs").alias("call_id"))
        .join(known, ["conv_id", "call_id"], "left")
        .select(
            "conv_id", "node", "turn", F.col("first_node").alias("other"), F.col("first_turn").alias("other_turn"),
            (F.struct("first_turn", "first_seq") >= F.struct("turn", "seq")).alias("forward"),
        ),
        "chat-edges",
    )
    tangled = edges.filter("forward and other <> node").select("conv_id").distinct()
    narrow = "conv_id", "node", "turn", "other", "other_turn"
    ordered = edges.join(tangled, "conv_id", "left_semi").select(*narrow).repartition("conv_id").sortWithinPartitions("conv_id")
    simple = (
        edges.join(tangled, "conv_id", "left_anti").groupBy("conv_id", "node")
        .agg(F.max("turn").alias("latest"), F.lit(False).alias("circular"), F.bool_or(F.col("other").isNull() | (F.col("other") == F.col("node"))).alias("nothing"))
    )
    waits = materialise(
        ordered.mapInArrow(_resolve, "conv_id long, node long, latest long, circular boolean, nothing boolean").union(simple), "chat-waits"
    )
    linked = (
        calls.join(results.select("conv_id", "call_id", "result"), ["conv_id", "call_id"], "left")
        .join(known, ["conv_id", "call_id"])
        .join(waits, ["conv_id", "node"], "left")
        .withColumn("first", F.col("node") == F.col("first_node"))
        .withColumn("at", F.coalesce("latest", "turn"))
    )
    orphans = (
        results.join(known, ["conv_id", "call_id"], "left")
        .join(waits.select("conv_id", F.col("node").alias("first_node"), "latest"), ["conv_id", "first_node"], "left")
        .select(
            "conv_id", F.coalesce("latest", "first_turn", "result_turn").alias("at"),
            (F.col("n") - F.when(F.col("first_node").isNull(), 0).otherwise(1)).alias("orphans"),
        )
        .filter("orphans > 0")
    )
    no, none = F.lit(False), F.lit(None).cast("string")
    columns = ["conv_id", "at", "turn", "role", "seq", "body", "kind", "call_id", "result", "first", "circular", "nothing"]
    rows = (
        messages.select(
            "conv_id", F.col("turn").alias("at"), "turn", "role", "seq", "body", "kind", none.alias("call_id"), none.alias("result"),
            no.alias("first"), no.alias("circular"), no.alias("nothing"),
        )
        .union(linked.withColumn("circular", F.coalesce("circular", no)).withColumn("nothing", F.coalesce("nothing", no)).select(*columns))
        .union(
            orphans.select(
                "conv_id", "at", F.col("at").alias("turn"), none.alias("role"), F.lit(0).alias("seq"), F.col("orphans").cast("string").alias("body"),
                F.lit("o").alias("kind"), none.alias("call_id"), none.alias("result"), no.alias("first"), no.alias("circular"), no.alias("nothing"),
            )
        )
    )
    grouped = rows.groupBy("conv_id", F.floor(F.col("at") / part_turns).alias("part")).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(*columns[2:]))),
            lambda e: F.struct(*[e[c].alias(c) for c in ("kind", "role", "call_id", "body", "result", "first", "circular", "nothing")]),
        ).alias("events")
    )
    return grouped.mapInArrow(
        _write(schemas or {}), "conv_id long, part long, n_messages long, n_calls long, n_bad_calls long, n_orphans long, chat string"
    )
