"""Schemas. Every table carries its media_id and an explicit order."""

from pyspark.sql import types as T

_TEXT, _INT, _LONG, _RAW = T.StringType(), T.IntegerType(), T.LongType(), T.BinaryType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CUE = _struct(media_id=_TEXT, cue_pos=_INT, cue_index=_TEXT, start_ms=_LONG, end_ms=_LONG, text=_TEXT)
FRAME = _struct(media_id=_TEXT, frame_id=_LONG, gray=_RAW)
FINGERPRINT = _struct(media_id=_TEXT, frame_id=_LONG, fp=_LONG)
KEYFRAME = _struct(media_id=_TEXT, id_frame=_LONG, frame_id=_LONG, fp=_LONG)
STREAM = _struct(index=_INT, codec_type=_TEXT, codec_name=_TEXT, width=_INT, height=_INT, r_frame_rate=_TEXT)
PROBE = _struct(streams=T.ArrayType(STREAM))
