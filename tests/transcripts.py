"""Builders for small transcript files."""

from __future__ import annotations

import json
from pathlib import Path


def session_id(n: int) -> str:
    return f"{n:08x}-1111-4222-8333-444455556666"


def stamp(minute: int) -> str:
    return f"2026-03-02T{9 + minute // 60:02d}:{minute % 60:02d}:00.000Z"


def user(text, minute=0, root=False, cwd="/work/app", branch="main", **more) -> dict:
    return {"parentUuid": None if root else "p", "type": "user", "message": {"role": "user", "content": text},
            "timestamp": stamp(minute), "cwd": cwd, "gitBranch": branch, **more}


def assistant(text, minute=0, cwd="/work/app", branch="main", **more) -> dict:
    content = [{"type": "thinking", "thinking": "hidden"}, {"type": "text", "text": text}, {"type": "tool_use", "input": {"text": "hidden"}}]
    return {"parentUuid": "p", "message": {"role": "assistant", "content": content}, "type": "assistant",
            "timestamp": stamp(minute), "cwd": cwd, "gitBranch": branch, **more}


def title(kind: str, text: str) -> dict:
    name = {"custom-title": "customTitle", "ai-title": "aiTitle", "last-prompt": "lastPrompt"}[kind]
    return {"type": kind, name: text}


def lines(*records, end="\n") -> str:
    return "".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + end for r in records)


def write(root: Path, n: int, text: str | bytes, project: str = "proj", append: bool = False) -> Path:
    folder = root / project
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"{session_id(n)}.jsonl"
    data = text.encode() if isinstance(text, str) else text
    with open(path, "ab" if append else "wb") as f:
        f.write(data)
    return path
