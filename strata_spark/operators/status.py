"""Serological status algebra: true, observed and any-antibody probabilities.

Joint statuses are named columns (``sp_np`` is S positive and N positive), so
they cannot be swapped by position.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JOINT = ("sp_np", "sn_np", "sp_nn", "sn_nn")
JOINT_LABELS = {"sp_np": "S+N+", "sn_np": "S-N+", "sp_nn": "S+N-", "sn_nn": "S-N-"}


def true_status(p: Column, pv: Column, resp_sn_np: Column, resp_sp_nn: Column) -> dict[str, Column]:
    """Probabilities of the four true statuses.

    ``p`` is infection, ``pv`` an S response to vaccination, and the two
    ``resp`` columns are the shares of infections that answer with N only and
    with S only. The double-positive status is the complement.
    """
    sp_nn = pv * (1.0 - p) + p * resp_sp_nn
    sn_np = p * resp_sn_np * (1.0 - pv)
    sn_nn = 1.0 - pv * (1.0 - p) - p
    return {"sp_np": 1.0 - (sp_nn + sn_np + sn_nn), "sn_np": sn_np, "sp_nn": sp_nn, "sn_nn": sn_nn}


def observed_status(true: dict[str, Column], sens_s: Column, spec_s: Column,
                    sens_n: Column, spec_n: Column) -> dict[str, Column]:
    """Probabilities of the four test results given the true statuses.

    Each assay turns its own true state into a result independently of the
    other; the last result is the complement.
    """
    s_positive = {"sp": sens_s, "sn": 1.0 - spec_s}
    n_positive = {"np": sens_n, "nn": 1.0 - spec_n}

    def result(s: str, n: str) -> Column:
        total = None
        for status, prob in true.items():
            ts, tn = status.split("_")
            ps = s_positive[ts] if s == "sp" else 1.0 - s_positive[ts]
            pn = n_positive[tn] if n == "np" else 1.0 - n_positive[tn]
            term = prob * ps * pn
            total = term if total is None else total + term
        return total

    out = {name: result(*name.split("_")) for name in JOINT[:3]}
    out["sn_nn"] = 1.0 - (out["sp_np"] + out["sn_np"] + out["sp_nn"])
    return out


def result_mass(true: dict[str, Column], s_result: Column, n_result: Column,
                sens_s: Column, spec_s: Column, sens_n: Column, spec_n: Column) -> Column:
    """Probability of the joint result a row holds: only that one of the four."""
    def given(result: Column, sens: Column, spec: Column) -> tuple[Column, Column]:
        # a missing result has no probability: null
        return (F.when(result == 1, sens).when(result == 0, 1.0 - sens),
                F.when(result == 1, 1.0 - spec).when(result == 0, spec))

    s_pos, s_neg = given(s_result, sens_s, spec_s)
    n_pos, n_neg = given(n_result, sens_n, spec_n)
    return (
        n_pos * (s_pos * true["sp_np"] + s_neg * true["sn_np"])
        + n_neg * (s_pos * true["sp_nn"] + s_neg * true["sn_nn"]))


def any_antibody(true: dict[str, Column]) -> Column:
    return 1.0 - true["sn_nn"]
