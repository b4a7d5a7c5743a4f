from tableflow.sources.scan import *  # noqa: F401,F403
from tableflow.sources.sink import *  # noqa: F401,F403
