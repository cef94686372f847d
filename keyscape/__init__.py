"""keyscape: network-terrain analytics expressed as Spark DataFrame jobs.

Every operator takes DataFrames and returns a DataFrame. ``functions`` holds
Column expressions, ``sources`` reads and writes, ``operators`` single steps,
``plans`` the composed jobs (scan, drift, hunt, declared diff, briefing map).
"""
