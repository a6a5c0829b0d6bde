"""Text that runs into an obstacle is wrapped before it, and what stands below moves down.

The order of the texts matters, as a text that has grown moves others, so the texts of one page (region) are one group:
small, whatever the number of pages. Widths come from average widths of characters, as fonts are not at hand.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

GAP, LEAST, LEADING = 8, 120, 1.15
CHAR = 0.5


def lines(text: str, size: float, width: float, char: float = CHAR) -> list[str]:
    """Words as long as they fit; a word that is too long for any line has its own."""
    out: list[str] = []
    for word in text.split():
        if out and (len(out[-1]) + 1 + len(word)) * char * size <= width:
            out[-1] += f" {word}"
        else:
            out.append(word)
    return out


def around_obstacles(texts: DataFrame, obstacles: DataFrame, char: float = CHAR) -> DataFrame:
    """texts(page_id, node_id, node_no, x, y, w, h, size, text) with text, y, w and h after wrapping; obstacles: page_id, x, y, w, h.

    A text is wrapped before the first obstacle, by place, that it runs into from the left with at least LEAST pixels of room. Null texts stay as they are; ties in node_no go by node_id.
    """
    names = ["page_id", "node_id", "node_no", "x", "y", "w", "h", "size", "text"]

    def one(key: tuple, own: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["node_no", "node_id"], kind="stable").reset_index(drop=True)
        rows = own.to_dict("records")
        walls = sorted(blocks[["x", "y", "w", "h"]].itertuples(index=False, name=None), key=lambda b: (b[1], b[0]))
        for row in rows:
            if not isinstance(row["text"], str):
                continue
            for bx, by, _, bh in walls:
                room = bx - row["x"] - GAP
                if row["x"] >= bx or row["y"] + row["h"] <= by or row["y"] >= by + bh or room < LEAST:
                    continue
                wrapped = lines(row["text"], row["size"], room, char)
                if len(wrapped) > 1:
                    bottom, tall = row["y"] + row["h"], max(row["h"], round(len(wrapped) * row["size"] * LEADING))
                    growth = tall - row["h"]
                    row |= {"text": "\n".join(wrapped), "w": min(row["w"], room), "h": tall}
                    for other in rows:
                        if growth and other is not row and other["x"] < bx and other["y"] >= bottom:
                            other["y"] += growth
                break
        return pd.DataFrame(rows, columns=names) if rows else own[names]

    schema = "page_id string, node_id string, node_no bigint, x bigint, y bigint, w bigint, h bigint, size double, text string"
    return texts.select(*names).groupBy("page_id").cogroup(obstacles.select("page_id", "x", "y", "w", "h").groupBy("page_id")).applyInPandas(one, schema)
