"""Small driver-side inputs: pipeline manifests, page specifications, variables."""

from __future__ import annotations

import re


class ManifestError(ValueError):
    pass


def page_numbers(spec: str) -> list[int]:
    """'1-3,7' as sorted distinct numbers."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        m = re.fullmatch(r"(\d+)(?:-(\d+))?", part)
        if not m or (m[2] and int(m[2]) < int(m[1])):
            raise ManifestError(f"bad range {part!r}")
        out.update(range(int(m[1]), int(m[2] or m[1]) + 1))
    return sorted(out)


def expand(text: str, variables: dict[str, str]) -> str:
    """${NAME} replaced; an undeclared name is an error."""

    def one(m: re.Match) -> str:
        if m[1] not in variables:
            raise ManifestError(f"undeclared variable {m[1]!r}")
        return variables[m[1]]

    return re.sub(r"\$\{(\w+)\}", one, text)


def stages(manifest: dict) -> list[tuple[str, dict]]:
    """(transform id, options) in the order of the manifest, which is never changed."""
    if not isinstance(manifest.get("transforms"), list):
        raise ManifestError("a manifest lists its transforms")
    for key in ("input", "render"):
        if key in manifest:
            raise ManifestError(f"a manifest does not name its {key}")
    out = []
    for entry in manifest["transforms"]:
        entry = {"id": entry} if isinstance(entry, str) else entry
        if not isinstance(entry, dict) or not isinstance(entry.get("id"), str):
            raise ManifestError("a transform needs an id")
        out.append((entry["id"], dict(entry.get("options") or {})))
    return out
