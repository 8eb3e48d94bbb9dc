"""Settings by layers, retries, and a managed section in a document: small driver-side helpers."""

from __future__ import annotations

import json
import os
import random
import re
from collections.abc import Callable, Iterator


def resolve(defaults: dict, *layers: dict, env_prefix: str | None = None) -> dict:
    """Later layers win; environment variables (prefix, upper-case key) win over all, read as JSON where they are."""
    out = dict(defaults)
    for layer in layers:
        out.update({k: v for k, v in layer.items() if v is not None})
    for k in out:
        raw = os.environ.get(f"{env_prefix}{k.upper().replace('.', '_')}") if env_prefix else None
        if raw is not None:
            try:
                out[k] = json.loads(raw)
            except ValueError:
                out[k] = raw
    return out


def delays(tries: int, base: float = 0.5, most: float = 30.0, seed: int | None = None) -> Iterator[float]:
    """Exponential waits with jitter."""
    rnd = random.Random(seed)
    for k in range(tries):
        yield min(most, base * 2**k) * (0.5 + rnd.random() / 2)


def retry(call: Callable, tries: int, retryable: Callable[[Exception], bool], sleep: Callable[[float], None]):
    """The result of call; a retryable failure waits and tries again, the last one is raised."""
    for wait in [*delays(tries - 1), None]:
        try:
            return call()
        except Exception as e:
            if wait is None or not retryable(e):
                raise
            sleep(wait)


def merge_section(document: str, body: str, name: str, stamp: str) -> str:
    """The document with its managed section replaced or added; unchanged when only the stamp would differ."""
    lo, hi = f"<!-- {name}:begin -->", f"<!-- {name}:end -->"
    section = f"{lo}\n{body.strip()}\n<!-- updated {stamp} -->\n{hi}"
    m = re.search(re.escape(lo) + r".*?" + re.escape(hi), document, re.S)
    if not m:
        return (document.rstrip() + "\n\n" if document.strip() else "") + section + "\n"
    plain = lambda s: re.sub(r"<!-- updated .*? -->", "", s)
    return document if plain(m[0]) == plain(section) else document[: m.start()] + section + document[m.end() :]
