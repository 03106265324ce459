"""Settings.  Where the reference leaves a default open, the value is ours."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ChunkSettings:
    """Linked child chunks and parents (budgets in tokens of the counter)."""

    strategy: str = "structural"  # structural, recursive or fixed
    chunk_tokens: int = 256  # ours
    chunk_overlap: int = 0  # ours
    max_seq_length: int = 512  # ours
    context_prefix: bool = True
    rows_as_chunks: bool = True
    ingest_version: str = "1"  # ours
    parent_tokens: int | None = None  # 4 x chunk_tokens
    dedup: bool = True
    dedup_min_tokens: int = 25
    min_section_tokens: int = 40
    title_in_parent: bool = True
    counter: str = "words"  # words, chars, or the path of a tokenizer file

    @property
    def parent_limit(self) -> int:
        return self.parent_tokens if self.parent_tokens is not None else 4 * self.chunk_tokens


@dataclass(frozen=True)
class HierarchySettings:
    """The heading-driven chunker."""

    max_tokens: int = 512
    min_tokens: int = 80
    merge_small_sections: bool = True
    table_mode: str = "markdown"  # markdown or rows
    tables_as_own_chunks: bool = True
    table_rows_per_chunk: int | None = None
    picture_min_tokens: int = 120
    include_footnotes: bool = True
    dedup_identical: bool = True
    overlap_sentences: int = 0
    counter: str = "chars"


@dataclass(frozen=True)
class HeadingSettings:
    detect_styles: bool = True
    detect_outline: bool = True
    detect_numbering: bool = True
    detect_formatting: bool = True
    use_toc: bool = True
    max_chars: int = 200
    max_words: int = 25
    size_ratio: float = 1.15
    max_signature_share: float = 0.30
    min_paragraphs_for_share_guard: int = 15
    allow_in_tables: bool = False
    allow_in_textboxes: bool = False


@dataclass(frozen=True)
class ParserSettings:
    include_furniture: bool = False
    include_footnotes: bool = True
    include_endnotes: bool = True
    include_textboxes: bool = True
    max_uncompressed_bytes: int = 1_000_000_000
    unwrap_layout_tables: bool = True
    detect_manual_lists: bool = True
    detect_repeated_furniture: bool = True
    repeated_min_count: int = 3
    detect_text_toc: bool = True
    image_mode: str = "reference"  # reference, embed or export
    headings: HeadingSettings = HeadingSettings()


@dataclass(frozen=True)
class VisionSettings:
    enabled: bool = False
    min_pixels: int = 4096
    max_images: int = 200
    skip_decorative: bool = True
    skip_repeated_min: int = 3
    concurrency: int = 4
    language: str = "français"
