"""Small corpora written to disk for end-to-end tests: an allotment garden's notes, of our own invention."""

from __future__ import annotations

import subprocess
from pathlib import Path

CONFIG = """
include = ["beds/**/*.md", "log/**/*.md"]
exclude = ["**/compost/**"]
id_prefixes = ["bed", "plant", "pest", "tool", "year", "entry"]
scope_field = "year"
"""

GARDEN = {
    "beds/old/terrace.md": "---\nid: terrace\ntype: bed\nname: The Terrace\nsuperseded_by: bed:slope\n---\nDug up.\n",
    "beds/old/slope.md": "---\nid: slope\ntype: bed\nname: The Slope\nsuperseded_by: bed:south-wall\n---\nDug up too.\n",
    "beds/south-wall.md": "---\nid: south-wall\ntype: bed\nname: South Wall\ngrows: [plant:fig, plant:rocket]\n---\nWarm; the [[plant:fig]] likes it.\n",
    "beds/frame.md": "---\nid: frame\ntype: bed\ngrows: plant:rocket\n---\n# Cold Frame\n\nGlass lid.\n",
    "beds/plants/fig.md": "---\nid: fig\ntype: plant\nname: Fig\naliases: [Ficus carica, brown turkey]\n---\n## Pruning\n\nIn frost-free weather.\n",
    "beds/plants/rocket.md": "---\nid: rocket\ntype: plant\nname: Rocket\nthreats: [pest:flea-beetle, '?pest: the grey slug']\n---\nSow thinly.\n\n## Flea beetle\n\nFlea beetle holes in June; a fleece helps against flea beetle.\n",
    "beds/plants/_nettle.md": "---\nid: nettle\ntype: plant\n---\nGrows by itself.\n",
    "beds/.wild/mint.md": "---\nid: mint\ntype: plant\n---\nNext to [[plant:nettle]].\n",
    "beds/plants/flea-beetle.md": "---\nid: flea-beetle\ntype: pest\nname: Flea beetle\n---\n",
    "beds/compost/heap.md": "---\nid: heap\ntype: bed\n---\nLeft out.\n",
    "log/y31/index.md": "---\nid: y31\ntype: year\nname: Year 31\n---\nDry.\n",
    "log/y31/june.md": (
        "---\r\nid: june-31\r\ntype: entry\r\nyear: year:y31\r\nseen: [pest:flea-beetle]\r\nbed: bed:terrace\r\n---\r\nTwo rows of [[plant:rocket|salad]] eaten, says [[?: the man next door]].\r\n\r\n"
        "## Fleece\r\n\r\nPut fleece over [[bed:slope]] and [[bed:frame]].\r\n\r\n~~~\r\n[[tool:drawn-only]]\r\n~~~\r\n"
    ),
    "log/y31/july.md": "---\nid: july-31\ntype: entry\nyear: year:y31\n---\nAfter [[entry:june-31]]: more fleece, fleece everywhere. Borrowed [[?tool: a long hoe]].\n",
    "log/readme.md": "No frontmatter, only [[plant:fig]].\n",
}


def write(root: Path, files: dict[str, str]) -> None:
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode("utf-8"))


def git(root: Path, *args: str) -> str:
    ran = subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.org", "-c", "core.autocrlf=false", *args], capture_output=True, text=True, check=True)
    return ran.stdout.strip()


def commit(root: Path, message: str = "change") -> str:
    if not (root / ".git").exists():
        git(root, "init", "-q")
    git(root, "add", "-A")
    git(root, "commit", "-q", "-m", message)
    return git(root, "rev-parse", "HEAD")


def make(root: Path, files: dict[str, str] = GARDEN, config: str = CONFIG) -> Path:
    from weftline import api

    api.init(root)
    (root / ".weftline" / "config.toml").write_text(config, encoding="utf-8")
    write(root, files)
    commit(root, "corpus")
    return root
