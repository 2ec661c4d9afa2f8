"""Row types shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Same layout as Spark's image source, without the origin path.
IMAGE = T.StructType(
    [
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("nChannels", T.IntegerType()),
        T.StructField("mode", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
    ]
)
IMAGE_DDL = "struct<height:int,width:int,nChannels:int,mode:int,data:binary>"
# Type codes of 8-bit images with one and three channels.
MODE_GRAY, MODE_BGR = 0, 16
RECT_DDL = "struct<x:int,y:int,w:int,h:int>"
POINT_DDL = "struct<x:float,y:float>"
STREAM = "stream_id"
FRAME = "frame_id"
KEYS = [STREAM, FRAME]
# First frame time; event time must never be 0.
EPOCH = "2024-01-01 00:00:00"
