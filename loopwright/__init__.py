"""Loopwright: PySpark operators that group located points along a road network and route each group as a loop."""
