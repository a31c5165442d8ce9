"""Tables kept in the folder that all executors share."""

from quadmill.store import Scope as Scope
from quadmill.store import keep as keep
from quadmill.store import shared_dir as shared_dir
