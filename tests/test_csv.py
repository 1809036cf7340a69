"""What the CSV reader refuses, and names and types as pandas gives them."""

import io

import pandas as pd
import pytest
from pyspark.sql import types as T

from realpay.sources import read_table
from realpay.sources.csv import _column_names

TEXT = T.StringType()


def write(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_bytes(text.encode())
    return str(folder)


def test_files_with_other_headers_are_refused(spark, tmp_path):
    path = write(tmp_path, a="id,name,score\n1,x,5.5\n2,y,6.5\n", b="score,id,name\n1.0,3,z\n")
    with pytest.raises(Exception, match="header"):
        read_table(spark, path).collect()
    schema = T.StructType([T.StructField(c, TEXT) for c in ("id", "name")])
    with pytest.raises(Exception, match="header"):
        read_table(spark, path, schema, lenient=True).collect()


def test_more_fields_than_the_header_are_refused(spark, tmp_path):
    path = write(tmp_path, a="id,name\n1,x\n2,y,EXTRA\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", TEXT)])
    for act in (lambda: read_table(spark, path), lambda: read_table(spark, path, schema).select("id").collect(), lambda: read_table(spark, path, schema).count()):
        with pytest.raises(Exception, match="expected 2 fields"):
            act()
    assert [tuple(r) for r in read_table(spark, path, lenient=True).orderBy("id").collect()] == [(1, "x"), (2, "y")]
    empty = write(tmp_path / "..", b="id,name\n1,x,\n")
    with pytest.raises(Exception, match="expected 2 fields"):
        read_table(spark, f"{empty}/b.csv").collect()


def test_fewer_fields_are_missing_values(spark, tmp_path):
    path = write(tmp_path, a='id,name,last\n1\n2,"b ""q"", c"\n\n3,,"\t"\n')
    rows = [tuple(r) for r in read_table(spark, path).orderBy("id").collect()]
    own = pd.read_csv(io.StringIO((tmp_path / "a.csv").read_text()))
    assert rows == [tuple(None if pd.isna(x) else x for x in r) for r in own.itertuples(index=False, name=None)]


@pytest.mark.parametrize("body", ['1,"x\ny",2\n', '"x\n1,y",2,3\n', '1,2,"x\ny,z,w"\n'])
def test_quoted_line_breaks_are_refused_or_read(spark, tmp_path, body):
    path = write(tmp_path, a="a,b,c\n" + body)
    schema = T.StructType([T.StructField(c, TEXT) for c in "abc"])
    for own in (None, schema):
        with pytest.raises(ValueError, match="multi_line"):
            read_table(spark, path, own)
    rows = [tuple(r) for r in read_table(spark, path, schema, multi_line=True).collect()]
    assert rows == [tuple(map(str, r)) for r in pd.read_csv(io.StringIO("a,b,c\n" + body), dtype=str).itertuples(index=False, name=None)]


def test_truth_values(spark, tmp_path):
    path = write(tmp_path, a="x,y,z\nTrue,true,True\nFalse,NA,maybe\nTRUE,False,false\n")
    df = read_table(spark, path)
    assert dict(df.dtypes) == {"x": "boolean", "y": "boolean", "z": "string"}
    assert [r["y"] for r in df.collect()] == [True, None, False]


@pytest.mark.parametrize("header", ["id,id,name", "id,id,id", "id,id.1,id", ",x,", "a,b,c", '"a,b",a,a'])
def test_column_names_are_those_of_pandas(spark, tmp_path, header):
    own = pd.read_csv(io.StringIO(f"{header}\n1,2,3\n"))
    path = write(tmp_path, a=f"{header}\n1,2,3\n", b=f"{header}\n4,5,6\n")
    df = read_table(spark, path)
    assert df.columns == list(own.columns)
    assert sorted(map(tuple, df.collect())) == [(1, 2, 3), (4, 5, 6)]


def test_renamed_headers_are_compared(spark, tmp_path):
    path = write(tmp_path, a="id,id,name\n1,2,x\n", b="id,name,id\n1,x,2\n")
    with pytest.raises(ValueError, match="header differs"):
        read_table(spark, path)


def test_without_header(spark, tmp_path):
    path = write(tmp_path, a="1,x\n2,y\n")
    assert sorted(map(tuple, read_table(spark, path, header=False).collect())) == [(1, "x"), (2, "y")]
    assert _column_names(["a", "a.1", "a"]) == ["a", "a.1", "a.2"]


def test_empty_file_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="no columns"):
        read_table(spark, write(tmp_path, a=""))
