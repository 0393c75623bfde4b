import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

OMP = (
    "rec_id long, batch_id int, received_at timestamp_ntz, machine string, project_id string, session_id string, source_path string, line_no int, type string, id string, parentid string, timestamp string, model string, "
    "message struct<id:string,role:string,content:array<struct<type:string,text:string,thinking:string,data:string,id:string,name:string,arguments:string>>,timestamp:string,"
    "usage:struct<input:long,output:long,cacheread:long,cachewrite:long>,model:string,provider:string,toolcallid:string,toolname:string,iserror:boolean>, output string, ident string, node string"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from loomspan.session import local_session

    s = local_session(os.environ.get("TEST_CPUS", "4"), 4, "3g")
    s.sparkContext.setLogLevel("OFF")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield s
    s.stop()


def item(kind="text", text=None, id=None, arguments=None):
    return (kind, text, None, None, id, None, arguments)


def omp_row(rec_id, id=None, parent=None, session="s", role="user", items=(), mid=None, output=None, batch=0, line=None, type="message", message=True, timestamp=None, machine="m", stamp=None):
    """A row of omp, with three columns more whose names the operators use inside."""
    usage = None if output is None else (1, output, 0, 0)
    body = (mid, role, None if items is None else list(items), stamp, usage, None, None, None, None, None) if message else None
    path = f"/home/u/.omp/agent/sessions/p/2026_{session}.jsonl"
    return (rec_id, batch, None, machine, "p", session, path, rec_id if line is None else line, type, id, parent, timestamp, None, body, "x", "x", "x")


@pytest.fixture(scope="session")
def omp(spark):
    return lambda rows: spark.createDataFrame(rows, OMP)
