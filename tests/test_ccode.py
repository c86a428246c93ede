"""The C path on awkward lines, by hand and against a plain reader of brackets."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import ccode
from tidemill.plans import rules as rl


@pytest.fixture(scope="module")
def steps():
    return lambda: ccode.steps(rl.HEADERS, rl.CUB_HEADERS, rl.TYPES, rl.C_SYMBOLS)


SOURCE = """#include <cuda_runtime.h>
# include "cub/device/device_scan.cuh"
#include <cub/device/device_sort.cuh> // sort
#include <vector>
cudaStream_t s; cudaSurfaceObject_t o; cudaDeviceProp p;
cudaMalloc(&a, n); cudaMalloc(&b, n); cudaFooBar(1); cudaCreateTextureObject(x);\r
kern<<<grid, block>>>(a, b);
  kern<<<dim3(1,2), dim3(f(a,b),4), 0, s>>>(g(a, b), h<int, 2>(c), "x,)") ; cub::DeviceScan::X();
k <<< g , b , 16 >>> ();
k<<<g>>>(x);
tmpl<int><<<a,b>>>(x);
k<<<a,b,c,d,e>>>;
k<<<a, >>>();
k<<<a < b, c>>>(unclosed, (x;
dim3 same; warp = 1"""

REWRITTEN = """#include <hip/hip_runtime.h>
#include <hipcub/device/device_scan.hpp>
#include <hipcub/device/device_radix_sort.hpp> // sort
#include <vector>
hipStream_t s; cudaSurfaceObject_t o; hipDeviceProp_t p;
hipMalloc(&a, n); hipMalloc(&b, n); cudaFooBar(1); cudaCreateTextureObject(x);\r
hipLaunchKernelGGL(kern, grid, block, 0, 0, a, b);
  hipLaunchKernelGGL(kern, dim3(1,2), dim3(f(a,b),4), 0, s, g(a, b), h<int, 2>(c), "x,)") ; hipcub::DeviceScan::X();
hipLaunchKernelGGL(k, g, b, 16, 0);
k<<<g>>>(x);
tmpl<int><<<a,b>>>(x);
hipLaunchKernelGGL(k, a, b, c, d, e);
k<<<a, >>>();
hipLaunchKernelGGL(k, a < b, c, 0, 0)(unclosed, (x;
dim3 same; warp = 1"""


def test_files(spark, steps):
    files = spark.createDataFrame([("a", SOURCE), ("b", SOURCE + "\n"), ("c", ""), ("d", None), ("e", "no mark\r\n\n")], "path string, text string")
    got = {r.path: r for r in ccode.migrated_files(files, steps()).collect()}
    assert got["a"].new_text == REWRITTEN and got["b"].new_text == REWRITTEN + "\n"
    assert (got["c"].new_text, got["d"].new_text, got["e"].new_text) == ("", "", "no mark\r\n\n")
    assert [(x.line, x.rule, x.confidence) for x in got["a"].applied] == [
        (1, "Header: cuda_runtime.h → hip/hip_runtime.h", 1.0),
        (2, "Header: cub/device/device_scan.cuh → hipcub/device/device_scan.hpp", 1.0),
        (3, "Header: cub/device/device_sort.cuh → hipcub/device/device_radix_sort.hpp", 1.0),
        (5, "Type: cudaStream_t → hipStream_t", 1.0),
        (5, "Type: cudaDeviceProp → hipDeviceProp_t", 1.0),
        (6, "cudaMalloc → hipMalloc", 1.0),
        (6, "cudaMalloc → hipMalloc", 1.0),
        (7, "Kernel launch <<<grid,block>>> → hipLaunchKernelGGL", 0.5),
        (8, "Kernel launch <<<grid,block,shared,stream>>> → hipLaunchKernelGGL", 0.7),
        (8, "Namespace: cub:: → hipcub::", 1.0),
        (9, "Kernel launch <<<grid,block,shared>>> → hipLaunchKernelGGL", 0.6),
        (12, "Kernel launch <<<grid,block,shared,stream>>> → hipLaunchKernelGGL", 0.7),
        (14, "Kernel launch <<<grid,block>>> → hipLaunchKernelGGL", 0.5),
    ]
    assert got["a"].applied[5].original == SOURCE.split("\n")[5].rstrip() and got["a"].applied[4].original.startswith("hipStream_t")
    assert [(x.line, x.symbol, x.confidence) for x in got["a"].remaining] == [
        (5, "cudaSurfaceObject_t", 0.6), (5, "cudaSurfaceObject_t", 0.6), (6, "cudaFooBar", 0.4), (6, "cudaCreateTextureObject", 0.8),
        (10, "<<<...>>>", 0.3), (11, "<<<...>>>", 0.3), (13, "<<<...>>>", 0.3),
    ]
    assert got["a"].remaining[0].reason == "Low-confidence type mapping (0.6) — Limited support"
    assert got["a"].remaining[3].reason == "Low-confidence API (80%) — Check ROCm version for support"


def test_blocks(spark, steps):
    text = 'x = 1\nm = """\n#include <cuda.h>\nk<<<a,b>>>(c);\n"""\ncudaMalloc(x)\nn = \'\'\'cudaFree(p)\n\'\'\' + """no""" + """open cudaFree('
    both = "'''cudaFree(a)''' \"\"\"'''cudaFree(b)'''\"\"\" '''"
    files = spark.createDataFrame([(0, text), (1, both), (2, None), (3, ""), (4, 'cudaFree(""" '), (5, '"""""" """cudaFree"""')], "id int, text string")
    got = {r.id: r for r in ccode.migrated_blocks(files, steps()).collect()}
    assert got[0].new_text == 'x = 1\nm = """\n#include <hip/hip_runtime.h>\nhipLaunchKernelGGL(k, a, b, 0, 0, c);\n"""\ncudaMalloc(x)\nn = \'\'\'hipFree(p)\n\'\'\' + """no""" + """open cudaFree('
    assert [x.line for x in got[0].applied] == [3, 4, 7]
    assert got[1].new_text == both.replace("cuda", "hip") and len(got[1].applied) == 2
    assert [got[i].new_text for i in (2, 3, 4, 5)] == ["", "", 'cudaFree(""" ', '"""""" """hipFree"""']


def _plain_split(text):
    parts, depth, angle, quote, last, part = [], 0, 0, "", "", ""
    for c in text:
        if quote:
            quote = "" if c == quote and last != "\\" else quote
        elif c in "\"'":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "<" and (last.isascii() and last.isalnum() or last == "_"):
            angle += 1
        elif c == ">" and angle:
            angle -= 1
        elif c == "," and not depth and not angle:
            parts.append(part)
            part, last = "", c
            continue
        part, last = part + c, c
    return [p.strip(" ") for p in [*parts, part]]


def _plain_closing(text):
    depth, quote, last = 0, "", ""
    for i, c in enumerate(text, 1):
        if quote:
            quote = "" if c == quote and last != "\\" else quote
        elif c in "\"'":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth == 0:
                return i
        last = c
    return 0


def test_brackets(spark):
    rng = random.Random(7)
    texts = ["", ",", "a, b", "f<a, b>(c), d"] + ["".join(rng.choices("ab(,)<>\"\\ [],,", k=rng.randint(0, 25))) for _ in range(300)]
    calls = ["(" + t for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", ccode.split_top(F.col("t")).alias("parts"), ccode.closing(F.concat(F.lit("("), "t")).alias("end")).collect()
    for r in rows:
        assert r.parts == _plain_split(texts[r.id]), texts[r.id]
        assert r.end == _plain_closing(calls[r.id]), calls[r.id]


def test_changes_are_listed_without_a_second_rewriting(spark, steps):
    files = spark.createDataFrame([(1, SOURCE), (2, "plain"), (3, None)], "id int, text string")
    out = ccode.listed(ccode.migrated_files(files, steps()), "applied", "id")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Kernel launch <<<grid,block>>>") == 1  # the plain form has it three times
    inner = ccode.migrated_files(files, steps()).select("id", F.inline("applied"))
    assert sorted(out.collect()) == sorted(inner.collect()) and out.count() > 8
