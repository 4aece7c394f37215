"""Measuring programs: timed runs, crosschecks, plan sweeps, and guards on resumed runs."""
