"""Schemas of the entities, as DDL strings."""

METADATA = (
    "pmcid string, doi string, title string, authors array<string>, journal string, pub_year int, keywords array<string>, "
    "article_type string, license string"
)
SECTION = "ord int, depth int, section_path array<string>, title string, content string"
TABLE = "id string, caption string, markdown string, section string"
FIGURE = "id string, caption string"
CANONICAL = (
    f"pmcid string, metadata struct<{METADATA}>, abstract string, sections array<struct<{SECTION}>>, "
    f"doc_tables array<struct<{TABLE}>>, figures array<struct<{FIGURE}>>, refs array<string>"
)
CHUNK_METADATA = (
    "pmcid string, title string, journal string, pub_year int, section string, subsection string, section_path array<string>, "
    "chunk_type string, token_count int"
)
CHUNK_TYPES = ("TEXT", "TABLE", "ABSTRACT", "FIGURE_CAPTION")
PAYLOAD = (
    "chunk_id string, pmcid string, title string, journal string, pub_year int, section string, subsection string, "
    "section_path array<string>, chunk_type string, token_count int, metadata_header string, article_type string, license string, content string"
)
