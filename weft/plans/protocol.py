"""The tools as a server of the Model Context Protocol over standard input and output.

Messages are JSON-RPC 2.0, one a line. What a tool takes is told by its signature. Requests that can't be answered
are results marked as errors, so that their message reaches the caller; anything unexpected is a JSON-RPC error.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any, get_type_hints

from weft import __version__
from weft.plans.tools import RequestError

VERSIONS = ("2025-06-18", "2025-03-26", "2024-11-05")
ABOUT = (
    "weft keeps a graph of this project's files: directories and tests, imports, changes that happened together, and references in documents. "
    "Ask related_files for what should be read or changed with the files you are about to edit; hidden_dependencies for files that change together though no import says so."
)
WRITING = ("rebuild_graph", "export_obsidian")
#: JSON-RPC's error codes.
BROKEN, INVALID, UNKNOWN, PARAMETERS, INTERNAL = -32700, -32600, -32601, -32602, -32603
_JSON_TYPES = {str: {"type": "string"}, int: {"type": "integer"}, bool: {"type": "boolean"}, list[str]: {"type": "array", "items": {"type": "string"}}}


class _Refused(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def described(name: str, f: Callable) -> dict[str, Any]:
    """A tool's entry in the list: its arguments from the signature, what it does from the docstring."""
    hints = get_type_hints(f)
    arguments = {}
    for p in inspect.signature(f).parameters.values():
        arguments[p.name] = _JSON_TYPES[hints[p.name]] | ({} if p.default is p.empty else {"default": p.default})
    needed = [p.name for p in inspect.signature(f).parameters.values() if p.default is p.empty]
    schema = {"type": "object", "properties": arguments, "required": needed, "additionalProperties": False}
    return {"name": name, "description": inspect.getdoc(f) or "", "inputSchema": schema, "annotations": {"readOnlyHint": name not in WRITING, "openWorldHint": False}}


def _fits(value: Any, kind: Any) -> bool:
    if kind == list[str]:
        return isinstance(value, list) and all(isinstance(x, str) for x in value)
    return isinstance(value, kind) and not (kind is int and isinstance(value, bool))


def _called(known: dict[str, Callable], params: dict[str, Any]) -> dict[str, Any]:
    f = known.get(params.get("name"))
    if f is None:
        raise _Refused(PARAMETERS, f"unknown tool: {params.get('name')}")
    given = params.get("arguments") or {}
    hints = get_type_hints(f)
    try:
        inspect.signature(f).bind(**given)
    except TypeError as e:
        raise _Refused(PARAMETERS, str(e)) from e
    if wrong := [k for k, v in given.items() if not _fits(v, hints[k])]:
        raise _Refused(PARAMETERS, f"wrong type: {', '.join(wrong)}")
    try:
        value = f(**given)
    except RequestError as e:
        return {"content": [{"type": "text", "text": str(e)}], "isError": True}
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)
    out = {"content": [{"type": "text", "text": text}], "isError": False}
    return out if isinstance(value, str) else out | {"structuredContent": json.loads(text) if isinstance(value, dict) else {"result": json.loads(text)}}


def _answered(known: dict[str, Callable], method: str, params: dict[str, Any]) -> dict[str, Any]:
    match method:
        case "initialize":
            asked = params.get("protocolVersion")
            return {
                "protocolVersion": asked if asked in VERSIONS else VERSIONS[0], "capabilities": {"tools": {"listChanged": False}},
                "serverInfo": {"name": "weft", "version": __version__}, "instructions": ABOUT,
            }
        case "ping":
            return {}
        case "tools/list":
            return {"tools": [described(n, f) for n, f in known.items()]}
        case "tools/call":
            return _called(known, params)
    raise _Refused(UNKNOWN, f"unknown method: {method}")


def answer(known: dict[str, Callable], line: str) -> str | None:
    """The answer to one message; None for notifications, which have no id."""
    number = None
    try:
        try:
            asked = json.loads(line)
        except ValueError as e:
            raise _Refused(BROKEN, str(e)) from e
        if not isinstance(asked, dict) or asked.get("jsonrpc") != "2.0" or not isinstance(asked.get("method"), str):
            raise _Refused(INVALID, "not a JSON-RPC 2.0 request")
        if "id" not in asked:
            return None
        number = asked["id"]
        said = {"result": _answered(known, asked["method"], asked.get("params") or {})}
    except _Refused as e:
        said = {"error": {"code": e.code, "message": str(e)}}
    except Exception as e:  # the server goes on; the caller learns what kind it was
        said = {"error": {"code": INTERNAL, "message": f"internal error: {type(e).__name__}"}}
    return json.dumps({"jsonrpc": "2.0", "id": number} | said, ensure_ascii=False)


def serve(known: dict[str, Callable], lines: Iterable[str]) -> Iterator[str]:
    """Answers to a stream of messages, one line each."""
    for line in lines:
        if line.strip() and (said := answer(known, line)) is not None:
            yield said
