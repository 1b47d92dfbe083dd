"""Java functions of this subpackage: compiled in the driver by the compiler that Spark has for its own code, and sent to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.types import BinaryType

#: SQL name and class of each function.
FUNCTIONS = {"lexloom_encode_ids": "lexloom.EncodeIds", "lexloom_decode_ids": "lexloom.DecodeIds"}
_SENT: set[str] = set()


def compiled(spark: SparkSession) -> dict[str, bytes]:
    """The bytecode of each class of this folder's Java files."""
    jvm = spark.sparkContext._jvm
    sources = [f.read_text() for f in sorted(Path(__file__).parent.glob("*.java"))]
    imports = sorted({x for s in sources for x in s.splitlines() if x.startswith("import ")})
    body = "\n".join(x for s in sources for x in s.splitlines() if not x.startswith(("import ", "package ")))
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook("\n".join(["package lexloom;", *imports, body.replace("public final class", "public class")]))
    return {entry.getKey(): bytes(entry.getValue()) for entry in compiler.getBytecodes().entrySet()}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session; Spark serves their classes to the executors, once for each application."""
    application = spark.sparkContext.applicationId
    if application not in _SENT:
        path = Path(tempfile.mkdtemp(prefix="lexloom-classes-")) / "lexloom-llm.jar"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as jar:
            for name, code in compiled(spark).items():
                jar.writestr(name.replace(".", "/") + ".class", code)
        spark.sql(f"ADD JAR '{path}'")
        _SENT.add(application)
    session = spark._jsparkSession
    loader = spark.sparkContext._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    for name, java in FUNCTIONS.items():
        session.udf().register(name, loader.loadClass(java).newInstance(), session.parseDataType(BinaryType().json()))
