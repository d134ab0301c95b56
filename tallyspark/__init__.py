"""Business analytics as Spark DataFrame plans.

The unit of work is a :class:`~tallyspark.model.Dataset`: a DataFrame plus the
role of each column (measure, dimension, date, ignored).  Every operator takes a
dataset or a frame and returns a lazily evaluated DataFrame.
"""

from tallyspark.model import AnalysisError, ColumnMeta, Dataset

__all__ = ["AnalysisError", "ColumnMeta", "Dataset"]
