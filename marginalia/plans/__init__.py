

from marginalia.plans import evaluation as evaluation, methods as methods, workbench as workbench  # register their queries
