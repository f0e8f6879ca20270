"""Column expressions. Everything here returns a ``Column``; nothing runs Python per row."""

from folio.functions.text import blank_to_null, empty_array_to_null, join_nonblank, utrim
from folio.functions.xml import direct_text, last_text, norm_tei, root_name, texts

__all__ = [
    "blank_to_null",
    "direct_text",
    "empty_array_to_null",
    "join_nonblank",
    "last_text",
    "norm_tei",
    "root_name",
    "texts",
    "utrim",
]
