"""Neighbouring cells that one point serves: their q are equal but for rounding, and only sums in the
order of the rows tell which is a maximum, as in the SQL."""

import duckdb
import numpy as np
import pandas as pd

from skyweave.operators import bands
from skyweave.plans import scan_queries


def test_maxima_of_cells_that_one_point_serves(spark):
    rng = np.random.default_rng(3)
    rows = []
    for target in range(400):
        # one point responds to 750 and 775 nm alone; the others make both lines' continuum
        x = np.append(rng.uniform(0.85, 0.929, 20), 0.7625 + rng.uniform(-1e-3, 1e-3))
        for wave in rng.permutation(x):
            rows.append((f"t{target}", wave, wave / 60, *(rng.integers(90000, 1e7, 2) / 100), 10.0 + 20 * rng.integers(1, 51), 12.0 + 20 * rng.integers(1, 51), False))
    table = pd.DataFrame(rows, columns=["target_id", "cwave_um", "cband_um", "aperture_flux_uJy", "psf_flux_uJy", "aperture_flux_unc_uJy", "psf_flux_unc_uJy", "fatal_flag_present"])
    con = duckdb.connect()
    con.execute("set threads=1")
    con.register("spectra_points", table)
    sql = scan_queries.DUAL_SQL + ", m as (select target_id, line_nm, q, lag(q, 1, -1e0) over (partition by target_id order by line_nm) as a, lead(q, 1, -1e0) over (partition by target_id order by line_nm) as b from scores) select target_id, line_nm from m where q >= a and q >= b"
    want = set(con.sql(sql).fetchall())
    scored = bands.dual_scan(spark.createDataFrame(table), bands.line_grid(spark, 750.0, 5000.0, 25.0), packed=("q",))
    got = {tuple(r) for r in scan_queries._maxima(bands.series_of(scored)).select("target_id", "line_nm").collect()}
    assert got == want
