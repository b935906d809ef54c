"""What is particular to one family of technical documents: names, patterns and thresholds, as data."""

from __future__ import annotations

from dataclasses import dataclass, field


# The defaults of a Profile (watermarks, noise, versions, variants, sections of registers, least lengths) must be these for right results.
@dataclass(frozen=True)
class Profile:
    """Settings of a document family. The defaults are those of flash-memory standards."""

    product: str = "eMMC"
    #: text that downloads and page headers leave in every page; callers add their licence holders' names and addresses
    watermarks: tuple[str, ...] = (r"Downloaded\s+by\s+[^\n]*", r"JEDEC\s+Standard\s+No\.\s+84-B51", r"Page\s+\d+")
    #: whole texts that are noise
    noise: tuple[str, ...] = (r"(cont'd|continued|continued\s+on\s+next\s+page|to\s+be\s+continued)\.?", r"(downloaded\s+by|JEDEC\s+Standard).*")
    #: (version, pattern), in the order in which versions are reported
    versions: tuple[tuple[str, str], ...] = (
        ("5.1", r"\b5\.1\b|[Bb]51\b|JESD84-B51\b"),
        ("5.0", r"\b5\.0\b|[Bb]50\b|JESD84-B50\b"),
        ("4.51", r"\b4\.51\b|\b4\.5\b|[Bb]451\b|JESD84-B451\b"),
    )
    default_version: str = "5.1"
    #: variants of the product's name in page text (after normalising marks), and in labels
    variants: tuple[tuple[str, str], ...] = ((r"(?i)e\s*[•∙\-.]\s*MMC", "eMMC"), (r"(?i)e\s*2\s*[•∙\-.]\s*MMC", "e.MMC"))
    label_variant: tuple[str, str] = (r"e\s*[•∙*.‐\-]+\s*mmc", "emmc")
    #: full tables of these sections stay searchable
    register_sections: tuple[str, ...] = ("CSD", "CID", "DSR", "OCR", "EXT_CSD")
    #: least length of a chunk's raw text, by type
    least_chars: dict[str, int] = field(default_factory=lambda: {"text": 20, "table": 80, "figure": 30, "bitmap": 30, "definition": 8, "register": 40})
    least_row_chunk: int = 25
    least_indexed_table: int = 25
    least_other: int = 30


DEFAULT = Profile()

# Titles of front matter, titles of definition sections, parts of titles that mark a page of
# definitions, marks of register text.
FRONT_MATTER = ["cover", "contents", "figures", "tables", "foreword", "introduction", "scope", "normative references", "terms", "definitions", "symbols", "abbreviations", "bibliography"]
DEFINITION_TITLES = ["definition", "abbreviation", "glossary", "terms", "terms and definitions", "symbols and abbreviations", "acronyms"]
DEFINITION_PARTS = ["definition", "abbreviation", "glossary", "terms", "acronym"]
REGISTER_WORDS = ["r/w", "r/w/e_p", "r/w/c_p", "r/wp", "otp", "reserved", "read/write", "read only", "write once"]
REGISTER_COLUMNS = ["bit", "index", "byte", "offset"]

# Characters of page text and what stands for them.
CHARACTERS = {
    "\u00a0": " ", "–": "-", "—": "-", "−": "-", "‘": "'", "’": "'", "“": '"', "”": '"',
    "µ": "u", "±": "+/-", "°": "deg", "≤": "<=", "≥": ">=", "×": "x", "•": "*", "…": "...",
}

# Chunk and page geometry.
CHUNK_CHARS, CHUNK_OVERLAP, SEPARATORS = 2800, 400, ["\n\n", "\n", ". ", " ", ""]
TABLE_CHARS = 6000
HEADER_MARGIN = FOOTER_MARGIN = 60.0
FIGURE_AREA, CLUSTER_PADDING, CAPTION_MARGIN, TABLE_PADDING = 5000.0, 4.0, 40.0, 2.0
TABLE_COLUMNS, FILL_RATE = 8, 0.40
RULE_WIDTH, RULE_GAP = 0.60, (10.0, 30.0)

# Retrieval.
RRF_K, N_RESULTS, N_SPARSE, MAX_DISTANCE = 60, 15, 40, 0.85
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
ID_NAMESPACE = "c7a3f2e1-84b0-5d9e-a012-3456789abcde"
