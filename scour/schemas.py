"""Fixed schemas for every table the pipeline reads or writes."""

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType(), True)

# The document index: content id, text, vector; id_prefix is the partition
# column used for partition-scoped upserts.
INDEX = T.StructType([
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("text", T.StringType(), True),
    T.StructField("embedding", VECTOR, True),
    T.StructField("run_id", T.LongType(), True),
    T.StructField("id_prefix", T.StringType(), True),
])

# Bloom filters of the stored ids: a row per write, prefix and block.
FILTERS = T.StructType([
    T.StructField("id_prefix", T.StringType(), True),
    T.StructField("blocks", T.IntegerType(), True),
    T.StructField("block", T.IntegerType(), True),
    T.StructField("bits", T.BinaryType(), True),
])

# A request event, as the gateway hands it over.
REQUEST_EVENT = T.StructType([
    T.StructField("resource", T.StringType(), True),
    T.StructField("path", T.StringType(), True),
    T.StructField("httpMethod", T.StringType(), True),
    T.StructField("queryStringParameters", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("body", T.StringType(), True),
    T.StructField("isBase64Encoded", T.BooleanType(), True),
])

# Answer-model response: output.message.content is a list of text parts.
MODEL_RESPONSE = T.StructType([
    T.StructField("output", T.StructType([
        T.StructField("message", T.StructType([
            T.StructField("role", T.StringType(), True),
            T.StructField("content", T.ArrayType(T.StructType([
                T.StructField("text", T.StringType(), True),
            ])), True),
        ]), True),
    ]), True),
])
