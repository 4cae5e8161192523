"""vigil: Spark-native operators for analysing tables of free-text responses.

Every public function takes and returns lazy Spark objects (``DataFrame`` or
``Column``); nothing is collected to the driver except size-checked
dimension tables (lexicons, label maps) that are turned into literals or
broadcast sides.
"""

from vigil.session import get_session, checkpoint_dir, materialize

__all__ = ["get_session", "checkpoint_dir", "materialize"]
