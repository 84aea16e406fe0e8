"""Structure-aware chunks: a fold over a document's blocks.

Headings end a chunk and begin a section; tables and figures stand alone; prose is packed up to a
target and hands on the tail of its last block as overlap.  Sections' headings are bound in front; a chunk
belongs to the section of its last block, so a tail that is carried past a heading goes with what follows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from foliant.functions import vocab
from foliant.session import ship

CHUNK = "chunk_id string, document_id string, content string, content_type string, page_start int, page_end int, section_path array<string>, char_start bigint, char_end bigint, table_ids array<string>, figure_ids array<string>, ocr_confidence double"
ATOMIC = ("table", "figure")


def chunk(document: str, blocks: list[dict], target: int = vocab.CHUNK_TARGET, overlap: int = vocab.CHUNK_OVERLAP) -> list[dict]:
    """Chunks of one document's blocks, in order."""
    out: list[dict] = []
    pending: list[dict] = []
    section, offset, current = 0, 0, []

    def emit(parts: list[dict]) -> None:
        nonlocal offset
        body = "\n\n".join(b["text"].strip() for b in parts if b["text"].strip())
        if not body:
            return
        path = parts[-1]["section_path"] or current
        head = " > ".join(path)
        content = body if not head or body.startswith(head) else f"{head}\n\n{body}"
        pages = [b["page"] for b in parts if b["page"] is not None]
        sure = [b["ocr_confidence"] for b in parts if b["ocr_confidence"] is not None]
        page = f"p{min(pages):04d}" if pages else "pxxx"
        out.append(
            {
                "chunk_id": f"{document}-{page}-s{section:02d}-c{len(out):03d}", "document_id": document, "content": content, "content_type": parts[0]["content_type"] if len(parts) == 1 else "paragraph",
                "page_start": min(pages, default=None), "page_end": max(pages, default=None), "section_path": list(path), "char_start": offset, "char_end": offset + len(content),
                "table_ids": [b["table_id"] for b in parts if b["table_id"]], "figure_ids": [b["figure_id"] for b in parts if b["figure_id"]], "ocr_confidence": round(min(sure), 3) if sure else None,
            }
        )
        offset += len(content)

    def close(carry: bool) -> None:
        """Ends the pending chunk; with ``carry`` its last block's tail begins the next one."""
        nonlocal pending
        if pending:
            last = pending[-1]
            emit(pending)
            tail = last["text"].strip()
            pending = [last | {"text": tail[-overlap:], "content_type": "paragraph"}] if carry and last["content_type"] != "heading" and len(tail) > overlap else []

    for block in blocks:
        kind = block["content_type"]
        if kind != "heading":  # a chunk that a heading ends is still of the section before it
            current = block["section_path"] or current
        if kind == "heading":
            close(carry=True)
            section += 1
        elif kind in ATOMIC:
            close(carry=False)
            emit([block])
        else:
            held = sum(len(b["text"]) for b in pending)
            if pending and held + len(block["text"]) > target:
                close(carry=True)
            pending.append(block)
    close(carry=False)
    return out


def chunked(blocks: DataFrame, target: int = vocab.CHUNK_TARGET, overlap: int = vocab.CHUNK_OVERLAP) -> DataFrame:
    """``chunk`` over a table of blocks (document_id, ordinal and a block's fields): a document is folded by one task."""
    names = [c.split()[0] for c in CHUNK.split(", ")]
    some = lambda x: None if x is None or x != x else x

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.sort_values("ordinal").to_dict("records"):
            page = some(r["page"])
            rows.append(r | {"page": None if page is None else int(page), "ocr_confidence": some(r["ocr_confidence"]), "section_path": list(r["section_path"])})
        return pd.DataFrame(chunk(pdf["document_id"].iloc[0], rows, target, overlap), columns=names)

    ship(blocks.sparkSession)
    return blocks.groupBy("document_id").applyInPandas(fold, CHUNK)
