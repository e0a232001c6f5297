"""Exceptions of rule compilation and evaluation; str() is a fixed prefix and the subject."""


class RuleError(Exception):
    """Base of all errors of this package."""

    prefix = ""

    def __init__(self, subject: object):
        super().__init__(f"{self.prefix}: {subject}" if self.prefix else str(subject))
        self.subject = subject


def _kind(name: str, prefix: str) -> type[RuleError]:
    return type(name, (RuleError,), {"prefix": prefix, "__doc__": f"{prefix}."})


# Message prefixes.
CompilationError = _kind("CompilationError", "Compilation error")
ExecutionError = _kind("ExecutionError", "Execution error")
YamlError = _kind("YamlError", "YAML parsing error")
UnsupportedMatchType = _kind("UnsupportedMatchType", "Unsupported match type")
InvalidRegex = _kind("InvalidRegex", "Invalid regex pattern")
InvalidIpAddress = _kind("InvalidIpAddress", "Invalid IP address")
InvalidCidr = _kind("InvalidCidr", "Invalid CIDR notation")
InvalidNumber = _kind("InvalidNumber", "Invalid number")
InvalidRange = _kind("InvalidRange", "Invalid range")
InvalidThreshold = _kind("InvalidThreshold", "Invalid threshold")
ModifierError = _kind("ModifierError", "Modifier error")
FieldExtractionError = _kind("FieldExtractionError", "Field extraction error")
InvalidNumericValue = _kind("InvalidNumericValue", "Invalid numeric value")
DangerousRegexPattern = _kind("DangerousRegexPattern", "Dangerous regex pattern detected")
RuleIoError = _kind("RuleIoError", "IO error")
