"""memlake: batch and streaming jobs over tables of agent memories, in PySpark."""
