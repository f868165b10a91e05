import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from codeloom.session import local_session  # noqa: E402
from source_rows import SOURCE  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, "codeloom-tests", {
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        # Rows are few and plans are many: compiling each plan would take most of the time.
        "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    })
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def project(spark, tmp_path):
    """Index one project given as path → text."""
    from codeloom import extract

    def build(files: dict[str, str], module: str = "example.com/testproject", **options):
        rows = [("p", module, path, f"/testproject/{path}", text) for path, text in files.items()]
        return extract(spark.createDataFrame(rows, SOURCE), folder=str(tmp_path / "index"), **options)

    return build


@pytest.fixture(scope="session")
def cases(spark, tmp_path_factory):
    """One index over the files of all cases of test_projects."""
    from codeloom import extract
    from test_projects import CASES

    rows = [(case, "example.com/testproject", path, f"/testproject/{path}", text) for case, files in CASES.items() for path, text in files.items()]
    index = extract(spark.createDataFrame(rows, SOURCE), folder=str(tmp_path_factory.mktemp("cases")))
    infos, contexts = {}, {}
    for r in index.file_info().collect():
        infos.setdefault(r.project, {})[r.file_path.removeprefix("/testproject/")] = r.info.asDict(recursive=True)
    for r in index.context().collect():
        contexts.setdefault(r.project, {})[r.file_path.removeprefix("/testproject/")] = r.text
    return infos, contexts


@pytest.fixture()
def infos(project, cases):
    """File information by path: of a named case, or of given files with options."""

    def read(files: dict[str, str] | str, **options) -> dict[str, dict]:
        if isinstance(files, str):
            return cases[0][files]
        rows = project(files, **options).file_info().collect()
        return {r.file_path.removeprefix("/testproject/"): r.info.asDict(recursive=True) for r in rows}

    return read


@pytest.fixture()
def contexts(project, cases):
    def read(files: dict[str, str] | str, **options) -> dict[str, str]:
        if isinstance(files, str):
            return cases[1][files]
        return {r.file_path.removeprefix("/testproject/"): r.text for r in project(files, **options).context().collect()}

    return read
