"""Stopword lists.

The default English list is the one shipped inside Spark's ML library
(``StopWordsRemover.loadDefaultStopWords('english')``).  It is read straight
from the jar so that it is available without a running JVM (oracle SQL).
"""

from __future__ import annotations

import functools
import glob
import os
import zipfile


@functools.lru_cache(maxsize=None)
def english_stopwords() -> tuple[str, ...]:
    import pyspark

    homes = [os.environ.get("SPARK_HOME", ""), os.path.dirname(pyspark.__file__)]
    try:
        from pyspark.find_spark_home import _find_spark_home
        homes.append(_find_spark_home())
    except Exception:  # noqa: BLE001
        pass
    jars = [j for h in homes if h for j in glob.glob(os.path.join(h, "jars", "spark-mllib_*.jar"))]
    for jar in jars:
        with zipfile.ZipFile(jar) as z:
            name = "org/apache/spark/ml/feature/stopwords/english.txt"
            if name in z.namelist():
                return tuple(w for w in z.read(name).decode("utf-8").split() if w)
    # Outside a pip-installed pyspark, ask the JVM.
    from pyspark.ml.feature import StopWordsRemover
    return tuple(StopWordsRemover.loadDefaultStopWords("english"))
