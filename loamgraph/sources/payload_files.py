"""Payload files: written once, never changed."""

import json
import os
import tempfile


class Divergent(RuntimeError):
    """Another payload lies under that name."""


def write_payload(path: str, payload: list[dict]) -> bool:
    """Writes the payload beside and then moves it into place; True if it was new. The same payload again is no write; another one is refused."""
    text = json.dumps(payload, ensure_ascii=False, sort_keys=True, indent=1) + "\n"
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            if json.load(f) == payload:
                return False
        raise Divergent(path)
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, beside = tempfile.mkstemp(dir=folder, suffix=".part")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(beside, path)
    return True
