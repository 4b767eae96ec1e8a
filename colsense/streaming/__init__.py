from colsense.streaming.incremental import (batch_types, merged_stream_errors, merged_stream_types, start_typing_stream,
                                            stream_batches, stream_errors, stream_types)

__all__ = ["batch_types", "merged_stream_errors", "merged_stream_types", "start_typing_stream", "stream_batches",
           "stream_errors", "stream_types"]
