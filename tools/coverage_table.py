"""Print the blueprint-row to query table used in the README."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetscope import catalog  # noqa: E402

registry = catalog.load()
by_tag: dict[str, list[str]] = {}
for name, tags in registry.COVERS.items():
    for tag in tags.split():
        mark = "" if name in registry.ORACLES else " (rows only)"
        by_tag.setdefault(tag, []).append(f"`{name}`{mark}")


def key(tag: str):
    return "SPAJWTV".index(tag[0]), int(re.sub(r"\D", "", tag))


print("| Row | Queries |\n| --- | --- |")
for tag in sorted(by_tag, key=key):
    print(f"| {tag} | {', '.join(by_tag[tag])} |")
