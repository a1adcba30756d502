"""Term lists, patterns, roles, units and tolerances of the datasheet vocabulary."""

from __future__ import annotations

# Terms of pages with mechanical dimensions.
DIMENSION_TERMS = (
    "external dimensions", "mechanical dimensions", "package dimensions", "package outline", "mechanical data",
    "type & dimension", "type and dimension", "nominal case size", "case size", "outline drawing", "outlines",
    "outline", "product dimensions", "dimensions (unit", "dimensions(mm)", "dimensions (mm)", "dimensions in inches",
    "dimensions in millimeters", "dimensions – millimeters", "dimensions - millimeters", "dimensions", "dimension",
    "产品结构和尺寸", "产品尺寸", "产品尺寸dimensions", "尺寸图dimensions", "尺寸图", "制品各项寸法", "制品尺寸", "外观尺寸",
    "外形尺寸", "寸法图", "尺寸",
)
# Terms of pages with land patterns.
BASE_LAND_TERMS = (
    "recommended land pattern", "suggested land pattern", "land pattern design", "recommended land dimensions",
    "recommended land size", "recommended pad dimensions", "recommended solder pad dimension",
    "recommended solder pad dimensions", "recommended solder pad size", "recommend solder pad size",
    "soldering pad size recommended", "solder pad dimensions", "land pattern", "land dimensions",
    "recommended footprint", "footprint dimensions", "recommended soldering pattern",
    "recommended mounting pad geometries", "pad dimensions", "land/pad pattern size", "board land size",
    "land pattern design recommendations", "pcb layout", "board layout", "pad layout", "recommended pad layout",
    "soldering pad", "hole pattern", "焊盘尺寸", "推荐焊盘", "推荐封装",
)
# Land terms of double weight.
ADDED_LAND_TERMS = (
    "pc board layout", "printed circuit board pattern", "solderable area", "i/o pads and solderable",
    "pwb processing dimension", "mounting hole layout", "through hole pattern", "suggest layout",
    "recommended layout", "padlayout", "推奨ランド", "実装パターン",
)
# Land terms that are as often references as drawings.
AMBIGUOUS_LAND_TERMS = ("land pattern", "pcb layout", "board layout", "pc board layout", "recommended layout", "pad layout", "suggest layout")
# Terms that veto a page.
FORBIDDEN_TERMS = ("tape and reel", "carrier tape", "reel dimensions", "packaging", "packaging quantity", "reflow profile", "solderability test", "revision history")
# Stems counted as land terms.
STEMS = {
    "recommended_pad_stem": r"\brecommend(?:ed|able|end)?\s+(?:(?:solder|mounting|solderable)\s+)?pads?\b",
    "suggested_pad_stem": r"\bsuggest(?:ed)?\s+(?:(?:solder|mounting)\s+)?pads?\b",
    "german_recommended_padlayout_stem": r"\bempfohlen(?:e|en|er|es|em)?\s*padlayout\b",
}
# Fixed value: a line that is a caption.
CAPTION = (
    r"^(?:fig(?:ure)?\.?\s*\d+|table\s*\d+|"
    r"(?:recommended|suggested|suggest|pc\s+board|printed\s+circuit\s+board|pwb|"
    r"mounting|through\s+hole|solderable|i/o\s+pads?|package|mechanical|outline|"
    r"land|pad|padlayout|empfohlen\w*)\b|推奨ランド|実装パターン|推荐焊盘|焊盘尺寸).{0,180}$"
)
#: Ends of lines as Python's splitlines sees them.
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"

# Package tokens, in order of priority: kind, pattern, group.
TOKEN_PATTERNS = (
    ("vendor_drawing_code", r"\b[A-Z]{1,5}\d{4}[A-Z]\b", 0),
    ("jedec_or_vendor_code", r"(?i)\bSOT\d{3,4}(?:-\d+)?\b", 0),
    ("drawing_number", r"\b\d{2}-\d{2}-\d{4}\b", 0),
    ("case_code", r"(?i)\bCASE\s+([A-Z0-9]+(?:-\d+)?)\b", 1),
    ("context_package_code", r"(?i)\b([A-Z]{2,5})\s+PACKAGE\b", 1),
    ("context_package_code", r"(?i)\(([A-Z]{2,5})\)\s*[-–—]?\s*\d", 1),
)
# Words that are never package tokens.
TOKEN_STOPS = ("BODY", "CASE", "DATA", "DIM", "DO", "IS", "JEDEC", "LAND", "LEAD", "MAX", "MIN", "NOTE", "OF", "OUTLINE", "PACKAGE", "REF", "THIS", "TYP")
# Terms of body pages and of pages that only look like them.
BODY_TERMS = ("package outline", "package dimensions", "mechanical data", "mechanical dimensions", "package drawing", "outline dimensions", "body dimensions")
NON_BODY_TERMS = ("table of contents", "tape and reel", "carrier tape", "reel dimensions", "ordering information", "package materials information")

# Markers that relate a package term to a package.
MARKERS = {
    "relation": r"\b(?:PACKAGE|CASE|OUTLINE|DIMENSIONS?|FOOT\s*PRINT|LAND\s*PATTERN|MECHANICAL\s+DATA|ORDERING\s+INFORMATION)\b|封装|外形|尺寸",
    "passive": r"\b(?:EIA|SIZE\s*CODE|MM\s*\(\s*INCH\s*\)|MINIATURE\s+FOOTPRINT)\b",
    "paired_size": r"\b[0-9]{4}\s*\(\s*(?:EIA\s*)?[0-9]{4}\s*\)|\bMINIATURE\s+FOOTPRINT\b",
    "drawing": r"\b(?:PACKAGE\s+)?DIMENSIONS?\b|\bDIMENSIONAL\s+OUTLINE\b",
    "label": r"\bPACKAGE\b|封装",
    "case": r"\bCASE\b",
    "outline": r"\bOUTLINE\b|\bPACKAGE\b",
    "header": r"\b(?:PACKAGE\s+(?:NAME|CODE)|(?:NAME|CODE)\s+PACKAGE|CASE\s+(?:NAME|CODE)|TYPE\s+NUMBER|PART\s+NUMBER|ORDERING\s+INFORMATION)\b",
}

# Roles, partitions and families.
ROLES = (
    "pad_width", "pad_height", "pad_gap", "pad_center_distance", "overall_span", "body_length", "body_width",
    "body_height", "tab_width", "tab_height", "half_pitch", "half_pitch_from_centerline", "center_to_edge",
    "gap_between_pads", "pitch", "paste_width", "paste_height", "lead_width", "other",
)
PARTITIONS = ("solder_land", "solder_paste", "package_outline", "occupied_area", "other")
FAMILIES = ("CHIP", "SMX", "SOT3", "ASYM3", "INLINE3", "GRID4", "DUAL", "QUAD_EP")
#: Exact millimetres of a unit.
UNIT_MM = {"mm": "1", "mil": "0.0254", "mils": "0.0254", "in": "25.4", "inch": "25.4", "inches": "25.4"}

# Tolerances in millimetres, ratios as fractions.
REGISTRY_TOL, CONSISTENT, PROVENANCE_TOL, CLOSURE, DUAL_CLOSURE = 0.001, 0.02, 0.011, 0.02, 0.05
UNIT_RATIO_TOL, DUAL_UNIT_TOL, GAP_TOL = 0.01, 0.02, 0.02
