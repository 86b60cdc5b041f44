"""DICOM JSON metadata: tag numbers become names, sequences become rows, by VARIANT values; no schema is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of tags, as far as image pyramids need them.
NAMES = {
    "00020010": "TransferSyntaxUID",
    "00080008": "ImageType",
    "00080016": "SOPClassUID",
    "00080018": "SOPInstanceUID",
    "00080060": "Modality",
    "00081115": "ReferencedSeriesSequence",
    "00081140": "ReferencedImageSequence",
    "00100010": "PatientName",
    "00180050": "SliceThickness",
    "0020000D": "StudyInstanceUID",
    "0020000E": "SeriesInstanceUID",
    "00200052": "FrameOfReferenceUID",
    "00209111": "FrameContentSequence",
    "00209221": "DimensionOrganizationSequence",
    "00280002": "SamplesPerPixel",
    "00280004": "PhotometricInterpretation",
    "00280008": "NumberOfFrames",
    "00280010": "Rows",
    "00280011": "Columns",
    "00280030": "PixelSpacing",
    "00280100": "BitsAllocated",
    "00280101": "BitsStored",
    "00280103": "PixelRepresentation",
    "00289110": "PixelMeasuresSequence",
    "00400512": "ContainerIdentifier",
    "0040072A": "XOffsetInSlideCoordinateSystem",
    "0040073A": "YOffsetInSlideCoordinateSystem",
    "00409096": "RealWorldValueMappingSequence",
    "00480006": "TotalPixelMatrixColumns",
    "00480007": "TotalPixelMatrixRows",
    "00480105": "OpticalPathSequence",
    "00480106": "OpticalPathIdentifier",
    "00480107": "OpticalPathDescription",
    "00480207": "OpticalPathIdentificationSequence",
    "0048021A": "PlanePositionSlideSequence",
    "0048021E": "ColumnPositionInTotalImagePixelMatrix",
    "0048021F": "RowPositionInTotalImagePixelMatrix",
    "00480302": "NumberOfOpticalPaths",
    "00480303": "TotalPixelMatrixFocalPlanes",
    "00620002": "SegmentSequence",
    "00620004": "SegmentNumber",
    "00620005": "SegmentLabel",
    "52009229": "SharedFunctionalGroupsSequence",
    "52009230": "PerFrameFunctionalGroupsSequence",
}


def naturalised(instances: DataFrame, key: str, json: str, depth: int = 5) -> DataFrame:
    """key, path, name, vr and value (VARIANT) of every element of instances' DICOM JSON, sequences down to depth.

    path names where an element lies, with the number of the item of each sequence. A single value is itself, several
    are an array, none is null; a tag without a name here keeps its number. A text that is no JSON object has no rows.
    An array of instances in one text, as a server gives it, is numbered in the path."""
    names = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    parsed = instances.select(F.col(key).alias("id_"), F.try_parse_json(F.col(json)).alias("v"))
    kind = F.schema_of_variant("v")
    one = parsed.where(kind.startswith("OBJECT")).select("id_", F.lit("").alias("at"), "v")
    each = parsed.where(kind.startswith("ARRAY"))
    several = _exploded(each, ["id_"], "v").select("id_", F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("].")).alias("at"), F.col("value").alias("v"))
    items, out = one.unionByName(several), None
    for level in range(depth):
        own = _exploded(items, ["id_", "at"], "v").select("id_", "at", F.upper("key_").alias("tag"), F.col("value").alias("e"))
        get = lambda path, kind: F.try_variant_get("e", path, kind)
        vr = F.coalesce(get("$.vr", "string"), F.lit("UN"))
        name = F.coalesce(names[F.col("tag")], F.col("tag"))
        own = own.select("id_", F.concat("at", name).alias("path"), name.alias("name"), vr.alias("vr"), get("$.Value", "variant").alias("several"), get("$.Value[0]", "variant").alias("first"), get("$.Value[1]", "variant").alias("second"))
        plain = own.where("vr <> 'SQ'").select("id_", "path", "name", "vr", F.when(F.col("second").isNull(), F.col("first")).otherwise(F.col("several")).alias("value"))
        out = plain if out is None else out.unionByName(plain)
        if level + 1 < depth:
            sequences = own.where("vr = 'SQ' and several is not null")
            items = _exploded(sequences, ["id_", "path"], "several").select("id_", F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("].")).alias("at"), F.col("value").alias("v"))
    return out.withColumnRenamed("id_", key)


def _exploded(rows: DataFrame, keep: list[str], variant: str) -> DataFrame:
    """keep, pos, key_ and value of each member of an object or an array."""
    spark = rows.sparkSession
    return rows.lateralJoin(spark.tvf.variant_explode(F.col(variant).outer())).select(*keep, "pos", F.col("key").alias("key_"), "value")
