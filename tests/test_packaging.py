"""Functions that run in Python tasks must load where the package is absent."""

import subprocess
import sys

import pytest
from pyspark import cloudpickle

from strata_spark.operators import fit, likelihood

LOAD = "import sys; from pyspark import cloudpickle; f = cloudpickle.loads(sys.stdin.buffer.read()); assert 'strata_spark' not in sys.modules"


@pytest.mark.parametrize("fn", [fit._Posterior, likelihood._tile_marginals(4, [[0.0]])])
def test_loads_without_the_package(fn):
    run = subprocess.run([sys.executable, "-c", LOAD], input=cloudpickle.dumps(fn), cwd="/", capture_output=True, timeout=120)
    assert run.returncode == 0, run.stderr.decode()[-500:]
