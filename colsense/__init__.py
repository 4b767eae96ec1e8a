"""colsense: column typing and conversion of untyped tables on Spark.

read (all text) -> profile (one grouped pass) -> decide -> convert (one
select) -> report errors -> page.  Every step is an ordinary DataFrame
function.
"""

from colsense.operators.chunks import (chunk_errors, chunk_types, concat_union, merge_chunk_errors,
                                       merge_chunk_types)
from colsense.operators.convert import (Result, category_codes, category_dictionary, convert,
                                        error_samples, errors_frame, infer_and_convert)
from colsense.operators.infer import decide, infer_types, types_dict
from colsense.operators.paging import page, page_count, preview_bool, preview_json, response
from colsense.operators.profile import profile
from colsense.operators.rowid import with_row_id
from colsense.sources.csv import DataTypeError, dropped_rows, read_csv, write_csv
from colsense.sources.encoding import audit_encodings

__all__ = [
    "DataTypeError", "Result", "audit_encodings", "category_codes", "category_dictionary",
    "chunk_errors", "chunk_types", "concat_union", "convert", "decide", "error_samples",
    "errors_frame", "infer_and_convert", "infer_types", "merge_chunk_errors", "merge_chunk_types",
    "dropped_rows", "page", "page_count", "preview_bool", "preview_json", "profile", "read_csv", "response",
    "types_dict", "with_row_id", "write_csv",
]
