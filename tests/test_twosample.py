import math

from assayframe.operators.twosample import two_sample


def test_one_constant_arm_calls_for_welch(spark):
    rows = [("second", "x", v) for v in (1.0, 2.0, 4.0)] + [("second", "y", 5.0)] * 3
    rows += [("first", "x", 5.0)] * 3 + [("first", "y", v) for v in (1.0, 2.0, 4.0)]
    rows += [("both", a, v) for a, v in (("x", 1.0), ("y", 2.0)) for _ in range(3)]
    got = {r.g: r for r in two_sample(spark.createDataFrame(rows, "g string, arm string, v double"), ["g"], "arm", "x", "y", ["v"]).collect()}
    assert got["second"].f == math.inf and got["second"].p_f == 0 and got["second"].choice == "welch" and got["second"].df == 2
    assert got["first"].f == 0 and got["first"].p_f == 0 and got["first"].choice == "welch" and got["first"].df == 2
    assert got["both"].f is None and got["both"].p_f is None and got["both"].choice is None
