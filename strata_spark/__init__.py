"""Survey post-stratification and posterior summaries on Spark DataFrames."""

from pyspark import cloudpickle

from strata_spark import fixed_values, functions, operators

# the few functions of these packages that run in Python tasks travel with the job, so executors
# need numpy, pandas and pyarrow but not this package
cloudpickle.register_pickle_by_value(fixed_values)
cloudpickle.register_pickle_by_value(functions)
cloudpickle.register_pickle_by_value(operators)
