"""Names: identifiers, column headers and table slugs (driver-side, a handful of strings)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from pathlib import PurePosixPath

IDENTIFIER = re.compile(r"[a-z_][a-z0-9_]*")
LONGEST_IDENTIFIER = 120
LONGEST_SLUG = 100

# Words that cannot be column names as they stand.
RESERVED_WORDS = frozenset(
    """
    select from where group order by join table column index primary key all and or not null
    true false case when then else end as on in is like limit offset union create drop insert
    update delete values into distinct having default with using cross inner outer left right
    """.split()
)

# File suffixes a delimited upload may carry, with their separators.
SEPARATORS = {".csv": ",", ".txt": ",", ".tsv": "\t"}


class InvalidName(ValueError):
    """A table, column or file name that cannot be used."""


def identifier(name: str) -> str:
    """Return ``name`` if it is a plain lower-case identifier, else raise."""
    if len(name) > LONGEST_IDENTIFIER or not IDENTIFIER.fullmatch(name):
        raise InvalidName(f"not a plain identifier: {name!r}")
    return name


def _words(text: str) -> str:
    return "_".join(re.findall(r"[a-z0-9]+", text.lower()))


def header_names(headers: Iterable[str]) -> list[str]:
    """Unique identifier-safe names for a header row, in order."""
    names: list[str] = []
    for position, header in enumerate(headers, start=1):
        plain = unicodedata.normalize("NFKD", header or "").encode("ascii", "ignore").decode()
        name = _words(plain) or f"column_{position}"
        if name[0].isdigit():
            name = "col_" + name
        if name in RESERVED_WORDS:
            name += "_col"
        name = name[:LONGEST_IDENTIFIER]
        candidate, copy = name, 1
        while candidate in names:
            copy += 1
            candidate = f"{name}_{copy}"
        names.append(candidate)
    return names


def table_slug(file_name: str, taken: Iterable[str] = ()) -> str:
    """Physical table name for an uploaded file, unique among ``taken``."""
    slug = _words(PurePosixPath(file_name).stem)
    if not slug:
        slug = "dataset"
    elif slug[0].isdigit():
        slug = "t_" + slug
    slug = slug[:LONGEST_SLUG]
    used = set(taken)
    for candidate in [slug, *(f"{slug}_{copy}" for copy in range(2, 200))]:
        if candidate not in used:
            return candidate
    raise InvalidName(f"no free table name left for {file_name!r}")


def separator_for(file_name: str) -> str:
    """Field separator of a delimited file; other suffixes are refused."""
    suffix = PurePosixPath(file_name).suffix.lower()
    if suffix not in SEPARATORS:
        raise InvalidName(
            f"unsupported file type {suffix or '(none)'}; use one of {', '.join(sorted(SEPARATORS))}"
        )
    return SEPARATORS[suffix]
