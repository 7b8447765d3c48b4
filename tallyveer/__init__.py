"""tallyveer: decision analytics over business facts, as Spark jobs.

Every public function takes DataFrames and returns DataFrames; nothing runs
until the caller writes, collects or streams the result.
"""

from tallyveer.config import AnalysisConfig
from tallyveer.plans.brief import Brief, analyze

__all__ = ["AnalysisConfig", "Brief", "analyze"]
