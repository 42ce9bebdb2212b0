"""riskspark: profile, clean and model tabular incident data on Spark.

Every public function takes and returns Spark ``DataFrame`` objects (or a
fitted model holding a small, bounded state).  Heavy work stays on Spark;
only bounded results (one row per column, one row per class, k centres)
ever reach the driver.
"""

from riskspark.roles import Roles

__all__ = ["Roles"]
__version__ = "0.1.0"
