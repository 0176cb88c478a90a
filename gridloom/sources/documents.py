"""JSON documents, household profiles, and the sinks that write them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.series import aligned, zipped

#: Fields of the documents and files (fixed values).
LOADS = "name string, bus long, bus_terminal string, phase string, phases int, connection string, model int, kv double, base_kw double, base_kvar double"
METERS = "meter_id string, load_name string, bus long, base_kw double, branch int, depth int, downstream_kw double, size_class string, on_backbone boolean"
NETWORK = (
    "source struct<name:string,base_kv:double,bus:string>, nodes array<struct<id:string,base_bus:bigint,kind:string,phases:array<string>>>, "
    "edges array<struct<id:string,from:string,to:string,device:string,phases:int,length:double,linecode:string>>, "
    "assets struct<transformers:array<struct<name:string,buses:array<string>,kva:array<double>>>,capacitors:array<struct<name:string,bus:string,kvar:double,kv:double>>,regulators:array<struct<name:string,transformer:string,winding:int>>>"
)
PROFILE = "datetime string, Global_active_power double, Global_reactive_power double, Voltage double, Global_intensity double"


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document, or an array of them, as rows."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_network(path: str, source: DataFrame, nodes: DataFrame, edges: DataFrame, transformers: DataFrame, capacitors: DataFrame, regulators: DataFrame) -> None:
    """A small network as one JSON document, in one row; `write_network_tables` is for any size."""

    def whole(rows: DataFrame, *columns) -> DataFrame:
        return rows.agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("x"))

    parts = [
        source.select(F.struct("name", "base_kv", "bus").alias("source")).limit(1),
        whole(nodes, "id", "base_bus", "kind", "phases").withColumnRenamed("x", "nodes"),
        whole(edges, "id", F.col("src").alias("from"), F.col("dst").alias("to"), "device", "phases", "length", "linecode").withColumnRenamed("x", "edges"),
        whole(transformers, "name", "buses", "kva").withColumnRenamed("x", "transformers"),
        whole(capacitors, "name", "bus", "kvar", "kv").withColumnRenamed("x", "capacitors"),
        whole(regulators, "name", "transformer", "winding").withColumnRenamed("x", "regulators"),
    ]
    one = parts[0]
    for p in parts[1:]:
        one = one.crossJoin(p)  # a row each
    one.select("source", "nodes", "edges", F.struct("transformers", "capacitors", "regulators").alias("assets")).coalesce(1).write.mode("overwrite").json(path)


#: The tables of a network and their columns, as its document has them (fixed values).
PARTS = {
    "source": "name string, base_kv double, bus string",
    "nodes": "id string, base_bus bigint, kind string, phases array<string>",
    "edges": "id string, `from` string, `to` string, device string, phases int, length double, linecode string",
    "transformers": "name string, buses array<string>, kva array<double>",
    "capacitors": "name string, bus string, kvar double, kv double",
    "regulators": "name string, transformer string, winding int",
}


def write_network_tables(path: str, **parts: DataFrame) -> None:
    """A network of any size as folders of JSON objects, one for each of PARTS that is given; edges may have src and dst for from and to."""
    for name, rows in parts.items():
        named = rows.withColumnsRenamed({"src": "from", "dst": "to"}) if name == "edges" else rows
        fields = [f.split()[0].strip("`") for f in PARTS[name].split(", ")]
        write_json(named.select(*[F.col(f"`{f}`") for f in fields]), f"{path}/{name}")


def network_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of PARTS of a network that `write_network_tables` wrote."""
    return spark.read.schema(PARTS[name]).json(f"{path}/{name}")


def profiles(spark: SparkSession, glob: str, folders: bool = False) -> DataFrame:
    """file, block, row and the columns of every household profile; files are CSV with a header. block and row tell the order of a file's rows.

    With `folders` a household is a folder of files, which follow each other by name, so a profile may have any size; `file` is the folder's name then.
    """
    rows = spark.read.schema(PROFILE).option("header", True).csv(glob)
    name, path, at = F.col("_metadata.file_name"), F.col("_metadata.file_path"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0")
    if not folders:
        return rows.select("*", name.alias("file"), at.alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select("*", F.element_at(F.split(path, "/"), -2).alias("file"), F.concat(name, F.lit(" "), at).alias("block"), F.monotonically_increasing_id().alias("row"))


def messages(readings: DataFrame, meters: DataFrame) -> DataFrame:
    """What meters send: the i-th file by name belongs to the i-th meter; the t-th tick is the t-th row of each file, as far as the shortest goes."""
    files = readings.select("file").distinct()
    paired = zipped(files, ["file"], meters.select("meter_id", "load_name", "bus"), ["meter_id"]).drop("i")
    out = aligned(readings, "file", ["block", "row"]).join(paired, "file")
    return out.select(F.col("tick").alias("timestamp"), "datetime", "meter_id", "load_name", "bus", F.col("Global_active_power").alias("p_kw"), F.col("Global_reactive_power").alias("q_kvar"), F.col("Voltage").alias("voltage"), F.col("Global_intensity").alias("current"))


def append_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)
